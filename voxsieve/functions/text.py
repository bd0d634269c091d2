"""Column functions on text, labels, URLs and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEFAULTS, EMOTION_CODES, FALSE_LABELS, TRUE_LABELS

# Every character Python's str.strip/str.split treats as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000"
# the same set as a pattern; the Unicode class is many times faster than listing the characters
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# after a blank, a word of three or more characters with an upper-case letter and no other kind of cased letter; the blank
# in front lets the search pass over a word at once, which a look behind at each character does not
CAPITALS = r" (?=[^ \p{Ll}\p{Lt}]{3,}+(?![^ ]))[^ \p{Lu}]*+\p{Lu}"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clamp(value: Column, low: float, high: float) -> Column:
    """The value kept within bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(value, F.lit(float(high)))))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def clean_text(text: Column, max_length: int | None = None) -> Column:
    """Trimmed text, whole unless a model's character limit is given; null when blank."""
    trimmed = strip(text)
    return F.when(trimmed != "", trimmed if max_length is None else F.substring(trimmed, 1, max_length))


def text_windows(text: Column, max_length: int = DEFAULTS.max_text_length) -> Column:
    """Consecutive pieces of at most `max_length` characters that together are the trimmed text."""
    trimmed = strip(text)
    starts = F.sequence(F.lit(0), F.floor((F.length(trimmed) - 1) / max_length).cast("int"))
    return F.when(trimmed != "", F.transform(
        starts, lambda i: F.substring(trimmed, i * max_length + 1, F.lit(max_length))))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping count of a literal substring."""
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))


def with_text_proxies(df: DataFrame, text: str = "text") -> DataFrame:
    """Word count, length, capitals, punctuation and word-length measures of a text column."""
    body = F.coalesce(F.col(text), F.lit(""))
    per_word = F.greatest(F.lit(1.0), F.col("num_words"))
    return (
        # single blanks between words let plain string functions do the counting
        df.withColumn("_flat", F.trim(F.regexp_replace(body, SPACE_RUN, " ")))
        .withColumn("_letters", F.length(F.replace("_flat", F.lit(" "), F.lit(""))))
        .withColumns({
            "num_words": F.when(F.col("_letters") > 0, F.length("_flat") - F.col("_letters") + 1)
            .otherwise(0).cast("double"),
            "num_chars": F.length(body).cast("double")})
        .withColumns({
            "caps_ratio": F.regexp_count(F.concat(F.lit(" "), "_flat"), F.lit(CAPITALS)) / per_word,
            "punct_intensity": (
                occurrences(body, "!") + 0.6 * occurrences(body, "?") + 0.8 * occurrences(body, "...")) / per_word,
            "avg_word_len": F.col("_letters") / per_word})
        .drop("_flat", "_letters")
    )


def normalize_label(label: Column, yes_no_letters: bool = True) -> Column:
    """Mixed text/number label to 1, 0 or null."""
    positive, negative = list(TRUE_LABELS), list(FALSE_LABELS)
    if yes_no_letters:
        positive.append("y")
        negative.append("n")
    key = F.lower(strip(label.cast("string")))
    number = F.when(key.rlike(NUMBER), key.try_cast("double"))
    whole = F.signum(number) * F.floor(F.abs(number))
    return (
        F.when(key.isin(positive), 1)
        .when(key.isin(negative), 0)
        .when(F.abs(number) < float("inf"), F.when(whole == 1.0, 1).otherwise(0))
        .cast("int")
    )


def normalize_emotion(emotion: Column) -> Column:
    """Short emotion code to its full name; anything else passes through."""
    names = F.create_map(*[F.lit(v) for pair in EMOTION_CODES.items() for v in pair])
    return F.coalesce(names[F.lower(emotion)], emotion)


def validate_url(url: Column, allow_empty: bool = False) -> Column:
    """Struct(valid, error) for a media address."""
    def outcome(valid: bool, error: str) -> Column:
        return F.struct(F.lit(valid).alias("valid"), F.lit(error).alias("error"))

    address = strip(url)
    empty = outcome(True, "") if allow_empty else outcome(False, "File URL is required")
    return (
        F.when(is_blank(url), empty)
        .when(~address.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), outcome(False, "Invalid URL format"))
        .when(~address.rlike(r"(?i)^https?:"), outcome(False, "File URL must use http or https protocol"))
        .when(address.rlike(r"(?i)^https?:[/\\]*[^/\\?#\s]+([/\\?#]|$)"), outcome(True, ""))
        .otherwise(outcome(False, "Invalid URL format"))
    )


def url_media_name(url: Column) -> dict[str, Column]:
    """File name, extension and result-file name implied by a media URL."""
    path = F.substring_index(url, "?", 1)
    name = F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("video"))
    suffix = F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)
    stem = F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^/.]+$", ""), F.lit("")), F.lit("result"))
    return {
        "media_name": name,
        "extension": F.coalesce(F.nullif(suffix, F.lit("")), F.lit(".mp4")),
        "result_name": F.concat(stem, F.lit("-result.json")),
    }


def file_stem(name: Column) -> Column:
    """Name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", "")


def timestamp_parts(seconds: Column) -> Column:
    """Struct(minute, second, text) with text as m:ss."""
    minute = (seconds / 60).cast("int")
    second = F.pmod(seconds, F.lit(60.0)).cast("int")
    return F.struct(
        minute.alias("minute"),
        second.alias("second"),
        F.concat(minute.cast("string"), F.lit(":"), F.lpad(second.cast("string"), 2, "0")).alias("text"),
    )


def decimals(value: Column, places: int) -> Column:
    """Fixed-point text, without digit grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def percent(value: Column) -> Column:
    """One-decimal percentage text of a 0-1 value."""
    return F.concat(decimals(value * 100, 1), F.lit("%"))


def highlight(extreme: Column, start: Column, end: Column, target: Column, target_confidence: Column,
              emotion: Column, emotion_score: Column) -> dict[str, Column]:
    """Background colour and tooltip lines of one displayed segment."""
    alpha = F.when(extreme > 0.5, extreme * 0.5)
    head = F.concat(
        timestamp_parts(start)["text"], F.lit("-"), timestamp_parts(end)["text"], F.lit(": "), percent(extreme))
    target_line = F.when(
        F.coalesce(target, F.lit("")) != "",
        F.concat(F.lit("Target: "), target, F.lit(" ("),
                 percent(F.coalesce(target_confidence, F.lit(0.0))), F.lit(")")))
    emotion_line = F.when(
        emotion.isNotNull(),
        F.concat(F.lit("Emotion: "), normalize_emotion(emotion), F.lit(" ("), percent(emotion_score), F.lit(")")))
    return {"alpha": alpha, "tooltip": F.concat_ws("\n", head, target_line, emotion_line)}
