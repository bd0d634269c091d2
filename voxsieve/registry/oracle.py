"""The same questions in DuckDB SQL, written from the definitions and not from the Spark plans.

Scores are kept as long rows (vec_id, model, label, score) and sentiment as joined tokens, where the
Spark side uses maps and array functions.
"""

from __future__ import annotations

from ..settings import (
    AUDIO_SUFFIXES, EMOTIONS, FALSE_LABELS, TOXIC_LABELS, TRUE_LABELS, VIDEO_SUFFIXES)
from .fixtures import EMOTION_CYCLE, LEXICON, MIXED_LABELS, TARGETS

SP = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

SQL: dict[str, str] = {}


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SP}+|{SP}+$', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{SP}+'), lambda w: w <> '')"


def clamp(e: str, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least(({e})::DOUBLE, {high}::DOUBLE))"


def quoted(values) -> str:
    return ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)


def with_(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- shared parts ---------------------------------------------------------------------------------

LEX = "lex(term, valence) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON.items()) + ")"


def proxies(source: str, text: str) -> str:
    """Sub-select adding the text proxies to every row of `source`."""
    return f"""
  SELECT *, len(w)::DOUBLE AS num_words, length({text})::DOUBLE AS num_chars,
    len(list_filter(w, lambda t: length(t) >= 3 AND t = upper(t) AND t <> lower(t))) / greatest(1.0, len(w)) AS caps_ratio,
    ((length({text}) - length(replace({text}, '!', '')))
      + 0.6 * (length({text}) - length(replace({text}, '?', '')))
      + 0.8 * ((length({text}) - length(replace({text}, '...', ''))) / 3)) / greatest(1.0, len(w)) AS punct_intensity,
    coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) / greatest(1.0, len(w)) AS avg_word_len
  FROM (SELECT *, {words(text)} AS w FROM {source})"""


def polarity(source: str, text: str, keys: str) -> list[str]:
    """CTEs tok and pol: neg, neu, pos and compound per key of `source`."""
    return [
        LEX,
        f"tok AS (SELECT {keys}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+')) AS term FROM {source})",
        f"""sums AS (SELECT {keys},
  sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END) AS n,
  count(*) FILTER (coalesce(valence, 0) = 0)::DOUBLE AS u, coalesce(sum(valence), 0) AS s
  FROM tok LEFT JOIN lex USING (term) WHERE term <> '' GROUP BY {keys})""",
        f"""pol AS (SELECT src.*, coalesce(n / (p + n + u), 0) AS neg, coalesce(u / (p + n + u), 0) AS neu,
  coalesce(p / (p + n + u), 0) AS pos, coalesce(s / sqrt(s * s + 15), 0) AS compound
  FROM {source} src LEFT JOIN sums USING ({keys}))""",
    ]


LINES = f"""lines AS (SELECT doc_id, 'doc_' || doc_id AS file, language, seg_idx, {strip('raw')} AS text FROM (
  SELECT doc_id, lang AS language, unnest(string_split(text, chr(10))) AS raw,
    (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS seg_idx FROM documents))"""

SEGS = [
    LINES,
    f"base AS ({proxies('lines', 'text')})",
    *polarity("base", "text", "file, seg_idx"),
    f"""heard AS (SELECT *, text = '' AS is_blank,
  CASE WHEN compound >= 0.4 AND pos > neg THEN 'happy'
    WHEN compound <= -0.4 AND neg >= greatest(pos, neu) THEN CASE WHEN neg > 0.6 THEN 'angry' ELSE 'disgust' END
    WHEN compound > -0.4 AND compound < 0 AND neg > 0.3 THEN 'sad' ELSE 'neutral' END AS emotion,
  {clamp('num_words / 2.5', 0.3, 30)} AS duration, {clamp('170 + 40 * (pos - neg)', 75, 600)} AS f0_mean,
  {clamp('15 + 60 * punct_intensity + 25 * caps_ratio + 20 * abs(compound)', 5, 80)} AS f0_std,
  {clamp('50 * (pos - neg) + 120 * punct_intensity', -100, 100)} AS f0_slope,
  {clamp('0.03 + 0.08 * caps_ratio + 0.06 * punct_intensity + 0.02 * abs(compound)', 0.005, 0.12)} AS rms_mean,
  CASE WHEN text = '' THEN NULL ELSE {clamp('0.8 * neg + 0.2 * (1 - neu)', 0, 1)} END AS overall_toxicity,
  text <> '' AND neg > 0.6 AS is_toxic FROM pol)""",
    f"""segs AS (SELECT *,
  {clamp('''CASE emotion WHEN 'happy' THEN pos WHEN 'angry' THEN neg WHEN 'disgust' THEN neg WHEN 'sad' THEN greatest(neg, -compound)
    ELSE CASE WHEN neu > 0 THEN neu ELSE 0.5 - abs(compound) / 2 END END''', 0, 1)} AS emotion_score,
  greatest(75.0, f0_mean - 1.2 * f0_std) AS f0_min, least(600.0, f0_mean + 1.2 * f0_std) AS f0_max,
  {clamp('2.8 * f0_std', 30, 300)} AS f0_range, {clamp('f0_mean + 0.15 * f0_slope', 75, 600)} AS f0_final,
  greatest(rms_mean, least(1.8 * rms_mean, 0.2)) AS rms_max,
  sum(duration) OVER (PARTITION BY file ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS end_s,
  sum(duration) OVER (PARTITION BY file ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) - duration AS start_s FROM heard)""",
]


def heuristic(source: str, name: str, heard: str = "true") -> list[str]:
    """CTEs that add h_score, h_conf and h_n to `source`."""
    return [
        f"""{name}_a AS (SELECT *, CASE WHEN f0_std > 0 THEN least(f0_std / 50.0, 1.0) ELSE 0 END AS ns,
  CASE WHEN f0_range > 0 THEN least(f0_range / 200.0, 1.0) ELSE 0 END AS nr,
  CASE WHEN rms_mean > 0 THEN least(rms_mean / 0.1, 1.0) ELSE 0 END AS ne, least(abs(f0_slope) / 50.0, 1.0) AS nl FROM {source})""",
        f"""{name}_b AS (SELECT *, CASE WHEN emotion_score > 0.5 AND lower(emotion) IN ('angry', 'fear', 'disgust') THEN 0.15 * emotion_score
  WHEN emotion_score > 0.5 AND lower(emotion) IN ('happy', 'neutral') THEN -0.05 * emotion_score END AS f1,
  CASE WHEN ns > 0.6 OR nr > 0.6 THEN 0.10 * greatest(ns, nr) END AS f2, CASE WHEN ne > 0.6 THEN 0.08 * ne END AS f3,
  CASE WHEN nl > 0.5 THEN 0.05 * nl END AS f4 FROM {name}_a)""",
        f"""{name}_c AS (SELECT *, coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) + coalesce(f4, 0) AS shift,
  (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + (f3 IS NOT NULL)::INT + (f4 IS NOT NULL)::INT AS cnt FROM {name}_b)""",
        f"""{name} AS (SELECT *, CASE WHEN {heard} THEN greatest(0.0, least(overall_toxicity + shift, 1.0)) ELSE overall_toxicity END AS h_score,
  CASE WHEN {heard} AND cnt > 0 THEN least(0.3 + 0.15 * cnt + 2.0 * (abs(shift) / cnt), 0.85)
    * CASE WHEN overall_toxicity < 0.2 OR overall_toxicity > 0.8 THEN 0.7 ELSE 1 END ELSE 0.0 END AS h_conf,
  CASE WHEN {heard} THEN cnt ELSE 0 END AS h_n FROM {name}_c)""",
    ]


DECIDED = [
    *SEGS, *heuristic("segs", "hs"),
    """decided AS (SELECT *, CASE WHEN is_blank THEN NULL ELSE h_score END AS prob,
  CASE WHEN is_blank THEN NULL ELSE h_score > 0.5 - 0.1 * h_conf END AS flag FROM hs)""",
    """roll AS (SELECT file, count(*) AS total_segments, count(*) FILTER (is_toxic) AS toxic_segments,
  coalesce(sum(overall_toxicity), 0) / count(*) AS avg_toxicity, coalesce(max(overall_toxicity), 0.0) AS max_toxicity,
  count(*) FILTER (flag) AS extremist_segments, coalesce(avg(prob), 0.0) AS avg_extremist_probability,
  coalesce(max(prob), 0.0) AS max_extremist_probability, count(*) FILTER (flag) / count(*) AS extremist_ratio,
  coalesce(sum(prob) FILTER (flag), 0.0) / count(*) AS weighted_extremist_score,
  CASE WHEN count(prob) > 0 THEN coalesce(sum(prob) FILTER (flag), 0.0) / count(*) > 0.3 END AS is_extremist_content,
  any_value(language) AS language FROM decided GROUP BY file)""",
]

MESSAGE = """CASE WHEN is_extremist_content THEN printf('EXTREMIST CONTENT DETECTED: %d/%d segments (%.1f%%). Weighted score: %.1f%%, Avg probability: %.1f%%',
    extremist_segments, total_segments, extremist_ratio * 100, weighted_extremist_score * 100, avg_extremist_probability * 100)
  WHEN NOT is_extremist_content THEN printf('Non-extremist content. %d/%d extremist segments detected (%.1f%%). Weighted score: %.1f%%',
    extremist_segments, total_segments, extremist_ratio * 100, weighted_extremist_score * 100)
  WHEN toxic_segments = 0 THEN 'No toxic content detected.'
  WHEN toxic_segments = 1 THEN printf('1 toxic segment detected (%.1f%% of content). Max toxicity: %.1f%%',
    toxic_segments / total_segments * 100, max_toxicity * 100)
  ELSE printf('%d toxic segments detected (%.1f%% of content). Average toxicity: %.1f%%, Max: %.1f%%',
    toxic_segments, toxic_segments / total_segments * 100, avg_toxicity * 100, max_toxicity * 100) END"""

ROLL_ROUNDED = ", ".join(
    ["file", "total_segments", "toxic_segments", "extremist_segments", "is_extremist_content", "language"] + [
        f"{r(c)} AS {c}" for c in ("avg_toxicity", "max_toxicity", "avg_extremist_probability", "max_extremist_probability",
                                   "extremist_ratio", "weighted_extremist_score")])


# --- score fixture, long form

EMB = "emb AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def sg(i: int) -> str:
    return f"(1 / (1 + exp(-12 * x[{i}])))"


def _sigmoid_rows(model: str, labels, first: int, shift: int, order: int) -> str:
    return "\nUNION ALL ".join(
        f"SELECT vec_id, '{model}' AS model, {order + i} AS pos, '{label}' AS label, 1 / (1 + exp(-(12 * x[{first + i}] - {shift}))) AS score FROM emb"
        for i, label in enumerate(labels))


def _softmax_rows(model: str, labels, terms, order: int) -> str:
    total = " + ".join(f"exp({t})" for t in terms)
    return "\nUNION ALL ".join(
        f"SELECT vec_id, '{model}' AS model, {order + i} AS pos, '{label}' AS label, exp({t}) / ({total}) AS score FROM emb"
        for i, (label, t) in enumerate(zip(labels, terms)))


LONG = [EMB, "long AS (" + "\nUNION ALL ".join([
    _sigmoid_rows("toxic", TOXIC_LABELS, 1, 2, 0),
    _softmax_rows("hate", ("HATE", "NOT-HATE"), ("12 * x[7] - 2", "12 * x[8]"), 10),
    _softmax_rows("offensive", ("offensive", "non-offensive"), ("12 * x[9] - 2", "12 * x[10]"), 20),
    _softmax_rows("sentiment", ("negative", "neutral", "positive"), ("12 * x[11]", "12 * x[12]", "12 * x[13]"), 30),
    _sigmoid_rows("target", TARGETS, 14, 1, 40)]) + ")"]

SCORES = [
    *LONG,
    """tox AS (SELECT vec_id, avg(score) AS overall_toxicity FROM (
  SELECT vec_id, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS k FROM long
  WHERE model = 'toxic' OR label IN ('HATE', 'offensive')) WHERE k <= 3 GROUP BY vec_id)""",
    """issues AS (SELECT vec_id, pos, model || '_' || label AS category, score FROM long
  WHERE score > 0.5 AND NOT regexp_matches(lower(model || '_' || label), 'nothate|not-offensive|neutral|positive'))""",
    """best AS (SELECT vec_id, label, score FROM (
  SELECT vec_id, label, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS k FROM long JOIN tox USING (vec_id)
  WHERE model = 'target' AND NOT contains(lower(label), 'not') AND score > 0.3 AND overall_toxicity > 0.5) WHERE k = 1)""",
    """scored AS (SELECT emb.vec_id, x, overall_toxicity, overall_toxicity > 0.5 AS is_toxic,
  list_aggregate(list_transform(string_split(replace(replace(best.label, '_', ' '), '-', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS hate_target, coalesce(best.score, 0.0) AS hate_target_confidence
  FROM emb JOIN tox USING (vec_id) LEFT JOIN best USING (vec_id))""",
]

ACOUSTIC = [
    *SCORES,
    f"""ac AS (SELECT *, 5 + 75 * {sg(21)} AS f0_std, 30 + 270 * {sg(22)} AS f0_range, 200 * x[23] AS f0_slope,
  0.3 + 9.7 * {sg(24)} AS duration, list_extract([{quoted(EMOTION_CYCLE)}], (vec_id % 6 + 1)::INT) AS emotion, {sg(25)} AS emotion_score,
  0.12 * {sg(26)} AS rms_mean, 170 + 40 * x[27] AS f0_mean FROM scored)""",
    """acoustic AS (SELECT *, least(1.8 * rms_mean, 0.2) AS rms_max, f0_mean - f0_range / 2 AS f0_min,
  f0_mean + f0_range / 2 AS f0_max, f0_mean AS f0_final FROM ac)""",
]

SARCASM = [
    *ACOUSTIC,
    """pat AS (
  SELECT vec_id, 'deadpan' AS name, 0.35 AS wt FROM acoustic WHERE f0_range > 150 AND f0_std < 20 AND duration > 2
  UNION ALL SELECT vec_id, 'monotone', 0.30 FROM acoustic WHERE f0_std < 15 AND duration > 3
  UNION ALL SELECT vec_id, 'emotion_mismatch', 0.40 FROM acoustic WHERE emotion IN ('happy', 'neutral') AND emotion_score > 0.5 AND overall_toxicity > 0.6
  UNION ALL SELECT vec_id, 'exaggerated', 0.30 FROM acoustic WHERE f0_range > 200 AND f0_std > 40
  UNION ALL SELECT vec_id, 'slow_delivery', 0.25 FROM acoustic WHERE duration > 5 AND f0_std < 25
  UNION ALL SELECT vec_id, 'happy_toxic', 0.45 FROM acoustic WHERE emotion = 'happy' AND emotion_score > 0.6 AND overall_toxicity > 0.4 AND overall_toxicity < 0.7)""",
    """sar AS (SELECT acoustic.*, (CASE WHEN name IS NULL THEN 0.0 ELSE least(mx + 0.3 * (sm - mx), 0.95) END)::DOUBLE AS sp, coalesce(name, 'none') AS sn
  FROM acoustic LEFT JOIN (SELECT vec_id, max(wt)::DOUBLE AS mx, sum(wt)::DOUBLE AS sm, arg_max(name, wt) AS name FROM pat GROUP BY vec_id) USING (vec_id))""",
]

JOINED = [*SCORES, LINES, """js AS (SELECT lines.*, text = '' AS is_blank, scored.x, scored.overall_toxicity, scored.is_toxic, scored.vec_id
  FROM lines JOIN scored ON scored.vec_id = (doc_id * 8 + seg_idx) % (SELECT count(*) FROM embeddings))"""]

LABELED = [f"""lab AS (SELECT doc_id AS row_id, text, toxic AS label, lang, source, n_chars, num_words, caps_ratio, punct_intensity, avg_word_len
  FROM (SELECT * FROM ({proxies('documents', 'text')}) LEFT JOIN labels USING (doc_id)))"""]

FILLED = [*LABELED, """filled AS (SELECT *, (avg_word_len + 20 * punct_intensity > 5.0)::INT AS pred,
  coalesce(label, (avg_word_len + 20 * punct_intensity > 5.0)::INT) AS label_filled FROM lab)"""]

NOTES = """notes AS (SELECT user_id AS comment_id, event_id AS note_id, CASE WHEN event_id % 7 <> 0 THEN value END AS rating,
  (props->>'$.k')::DOUBLE AS k, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 0 END AS label,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events)"""

SL = [EMB, """sl AS (SELECT vec_id, 1 / (1 + exp(-(12 * x[1] - 2))) AS score, (x[1] + 1.5 * x[2] > 0.1)::INT AS y,
  (1 / (1 + exp(-(12 * x[1] - 2))) >= 0.5)::INT AS pred FROM emb)"""]

BOTH = [*SL, """both_sl AS (SELECT 'exact' AS variant, score, y FROM sl UNION ALL SELECT 'tied', round(score, 2), y FROM sl)"""]

BARE = "regexp_replace(url, '[?#].*$', '')"
URLS = f"""urls AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN {BARE} || '.MP4?x=1' WHEN 1 THEN {BARE} || '.wav'
  WHEN 2 THEN regexp_replace(url, '^https?:', 'ftp:') WHEN 3 THEN regexp_replace(url, '^https?://', '') WHEN 4 THEN '' WHEN 5 THEN NULL
  WHEN 6 THEN {BARE} || '/clip.final.mp3' WHEN 7 THEN 'https://' ELSE url END AS url FROM pages)"""


# --- sources and sinks ------------------------------------------------------------------------------

SQL["read_transcripts"] = f"""SELECT 'doc_' || doc_id AS file, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE 'unknown' END AS language,
  {strip('text')} AS text, len(string_split(text, chr(10))) AS n_segments FROM documents"""

SQL["explode_segments"] = with_([LINES], "SELECT file, language, seg_idx, text FROM lines WHERE text <> ''")

SQL["read_labeled_csv"] = f"""SELECT {strip('text')} AS text, toxic AS label FROM documents JOIN labels USING (doc_id)
  WHERE {strip('text')} <> '' AND NOT (toxic = 0 AND doc_id % 4 = 2)"""

TSV = r"""tsv AS (SELECT doc_id AS row_id, regexp_replace(text, '["\s]+', ' ', 'g') AS text, CASE WHEN doc_id % 3 < 2 THEN toxic END AS label,
  CASE WHEN doc_id % 3 = 2 THEN lang END AS lang, source || '_' || doc_id % 3 || '.tsv' AS name FROM documents LEFT JOIN labels USING (doc_id))"""
SQL["union_tsv_dir"] = with_([TSV], "SELECT row_id, text, label, lang FROM tsv")
SQL["split_tsv_dir"] = with_([TSV], """SELECT name, CASE WHEN bad THEN 'failed' ELSE 'split' END AS status, n_rows,
  CASE WHEN NOT bad THEN (n_rows + 6) // 7 END AS n_parts, CASE WHEN bad THEN 'line break within quotes' END AS error, CASE WHEN NOT bad THEN part END AS part,
  CASE WHEN NOT bad THEN count(*) END AS rows_of_part, CASE WHEN NOT bad THEN min(row_id) END AS first_id, CASE WHEN NOT bad THEN max(row_id) END AS last_id
  FROM (SELECT *, name = 'src4_0.tsv' AS bad, count(*) OVER (PARTITION BY name) AS n_rows,
    CASE WHEN name = 'src4_0.tsv' THEN 0 ELSE (row_number() OVER (PARTITION BY name ORDER BY row_id) - 1) // 7 + 1 END::INT AS part FROM tsv)
  GROUP BY name, bad, n_rows, part""")

SQL["read_annotations"] = f"SELECT user_id AS comment_id, count(*) AS n_annotations, {r('avg(value)')} AS rating FROM events GROUP BY user_id"

_AUDIO, _VIDEO = "|".join(AUDIO_SUFFIXES), "|".join(VIDEO_SUFFIXES)
SQL["media_manifest"] = f"""SELECT page_id, path, CASE WHEN regexp_matches(path, '(?i)[^/.]\\.({_AUDIO})$') THEN 'audio' ELSE 'video' END AS file_type
  FROM (SELECT page_id, {BARE} || list_extract(['.mp4', '.MP3', '.txt', '', '.wav', '.json'], (page_id % 6 + 1)::INT) AS path FROM pages)
  WHERE regexp_matches(path, '(?i)[^/.]\\.({_AUDIO}|{_VIDEO})$')"""

SQL["url_media_name"] = with_([URLS], r"""SELECT page_id, CASE WHEN last = '' THEN 'video' ELSE last END AS media_name,
  CASE WHEN regexp_matches(last, '^.*[^.].*\.[^.]*$') THEN '.' || list_extract(string_split(last, '.'), -1) ELSE '.mp4' END AS extension,
  coalesce(nullif(regexp_replace(CASE WHEN last = '' THEN 'video' ELSE last END, '\.[^.]+$', ''), ''), 'result') || '-result.json' AS result_name
  FROM (SELECT page_id, list_extract(string_split(list_extract(string_split(url, '?'), 1), '/'), -1) AS last FROM urls WHERE url IS NOT NULL)""")

SQL["pair_feature_files"] = """SELECT 'doc_' || doc_id AS base, 'doc_' || doc_id || '_multimodel.json' AS text_file,
  'doc_' || doc_id || '_intonation.json' AS acoustic_file, (coalesce(toxic, 0) = 1)::INT AS label
  FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0"""

SQL["write_results"] = with_(DECIDED, f"""SELECT file, total_segments, extremist_segments, {MESSAGE} AS result,
  total_segments AS stored_segments FROM roll""")

SQL["export_columns"] = r"""SELECT toxic AS label, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents LEFT JOIN labels USING (doc_id)"""

_ACOUSTIC = ("emotion_score", "f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_slope", "f0_final", "rms_mean", "rms_max", "duration")

# the segment formulas applied to whole labelled texts
_DOC_SEGS = [p.replace("lines AS (", "unused_lines AS (") if p is LINES else p for p in SEGS]
_DOC_SEGS.insert(1, "lines AS (SELECT doc_id AS file, 0 AS seg_idx, text, toxic AS label FROM documents JOIN labels USING (doc_id))")
SQL["dump_features"] = with_(_DOC_SEGS, "SELECT label, emotion AS inton_emotion, " + ", ".join(
    f"{r(c)} AS inton_{c}" for c in _ACOUSTIC) + f""", {r(clamp('0.8 * neg + 0.2 * (1 - neu)', 0, 1))} AS tox_overall, {r('neg')} AS toxic_toxic,
  {r('neg / 2')} AS toxic_severe_toxic, 0.0::DOUBLE AS toxic_obscene, 0.0::DOUBLE AS toxic_threat, {r('greatest(0.0, neg - 0.2)')} AS toxic_insult,
  0.0::DOUBLE AS toxic_identity_hate FROM segs""")

SQL["split_parts"] = """SELECT part, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (
  SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1)::BIGINT AS part FROM orders) GROUP BY part"""

SQL["dead_letter"] = """SELECT event_id::VARCHAR AS file, CASE WHEN event_id % 13 <> 0 THEN (props->>'$.k')::BIGINT END AS k,
  CASE WHEN event_id % 13 = 0 THEN 'event' END AS file_type, CASE WHEN event_id % 13 = 0 THEN 'JSONDecodeError' END AS error_type,
  CASE WHEN event_id % 13 = 0 THEN 'cannot parse: ' || props[1:length(props) - 1] END AS error_message FROM events"""

SQL["skip_existing"] = "SELECT 'doc_' || doc_id || '.mp4' AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

SQL["run_summary"] = """SELECT count(*) AS total, count(*) FILTER (toxic IS NOT NULL AND n_chars >= 300) AS processed,
  count(*) FILTER (toxic IS NULL) AS skipped, count(*) FILTER (toxic IS NOT NULL AND n_chars < 300) AS failed
  FROM documents LEFT JOIN labels USING (doc_id)"""

SQL["reload_results"] = """SELECT 'doc_' || doc_id AS file, doc_id % 6 <> 0 AND doc_id % 11 <> 0 AS valid,
  CASE WHEN doc_id % 6 = 0 OR doc_id % 11 = 0 THEN 'Invalid JSON format. Expected result format with ''success'' and ''segments'' fields.' END AS error,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS n_segments FROM documents"""

# --- projections and filters

SQL["validate_url"] = with_([URLS], """SELECT page_id, error = '' AS valid, error, error = '' OR error = 'File URL is required' AS valid_or_empty FROM (
  SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'File URL is required' WHEN NOT contains(url, ':') THEN 'Invalid URL format'
    WHEN NOT starts_with(url, 'http:') AND NOT starts_with(url, 'https:') THEN 'File URL must use http or https protocol'
    WHEN list_extract(string_split(url, '/'), 3) = '' THEN 'Invalid URL format' ELSE '' END AS error FROM urls)""")

SQL["segment_validity"] = with_(SEGS, f"""SELECT file, seg_idx, {r('start_s')} AS start_s, {r('e')} AS end_s, {r('e - start_s')} AS duration FROM (
  SELECT *, CASE seg_idx % 5 WHEN 1 THEN start_s + 0.05 WHEN 2 THEN start_s ELSE end_s END AS e FROM segs)
  WHERE e > start_s AND e - start_s >= 0.1""")

def _mss(e: str) -> str:
    return f"(floor({e} / 60)::INT || ':' || lpad(floor({e} % 60)::INT::VARCHAR, 2, '0'))"

SQL["timestamp_parts"] = with_(SEGS, f"""SELECT file, seg_idx, floor(a / 60)::INT AS start_minute, floor(a % 60)::INT AS start_second,
  {_mss('a')} AS start_text, {_mss('b')} AS end_text FROM (SELECT file, seg_idx, round(start_s, 3) AS a, round(end_s, 3) AS b FROM segs)""")

SQL["clean_text"] = f"SELECT doc_id, {strip('text')} AS text FROM documents WHERE doc_id % 10 <> 0 AND {strip('text')} <> ''"

SQL["highlight_segments"] = with_(ACOUSTIC, f"""SELECT vec_id, CASE WHEN overall_toxicity > 0.5 THEN {r('overall_toxicity * 0.5')} END AS alpha,
  concat_ws(chr(10), {_mss('a')} || '-' || {_mss('b')} || ': ' || printf('%.1f%%', overall_toxicity * 100),
    CASE WHEN hate_target IS NOT NULL THEN printf('Target: %s (%.1f%%)', hate_target, hate_target_confidence * 100) END,
    printf('Emotion: %s (%.1f%%)', CASE emotion WHEN 'angry' THEN 'Angry' WHEN 'fear' THEN 'Fear' WHEN 'happy' THEN 'Happy'
      WHEN 'neutral' THEN 'Neutral' WHEN 'sad' THEN 'Sad' ELSE 'Disgust' END, emotion_score * 100)) AS tooltip
  FROM (SELECT *, vec_id * 1.5::DOUBLE AS a, vec_id * 1.5::DOUBLE + round(duration, 3) AS b FROM acoustic)""")

SQL["transcript_quality_gate"] = with_([EMB], f"""SELECT vec_id, {r('c')} AS compression_ratio, {r('p')} AS mean_logprob, {r('q')} AS no_speech_prob
  FROM (SELECT vec_id, 4 * {sg(30)} AS c, -2 * {sg(31)} AS p, {sg(32)} AS q FROM emb) WHERE NOT (c > 2.4 OR p < -1.0 OR q > 0.6)""")

# --- scalar functions

SQL["text_proxies"] = f"""SELECT doc_id, num_words, num_chars, {r('caps_ratio')} AS caps_ratio, {r('punct_intensity')} AS punct_intensity,
  {r('avg_word_len')} AS avg_word_len FROM ({proxies('documents', 'text')})"""


def _label(letters: bool) -> str:
    yes, no = TRUE_LABELS + (("y",) if letters else ()), FALSE_LABELS + (("n",) if letters else ())
    return f"""CASE WHEN k IN ({quoted(yes)}) THEN 1 WHEN k IN ({quoted(no)}) THEN 0
    WHEN try_cast(k AS DOUBLE) IS NOT NULL THEN (trunc(try_cast(k AS DOUBLE)) = 1)::INT END"""


SQL["normalize_label"] = f"""SELECT event_id, {_label(False)} AS train_label, {_label(True)} AS fill_label FROM (
  SELECT event_id, lower(trim(list_extract([{quoted(MIXED_LABELS)}], (event_id % {len(MIXED_LABELS)} + 1)::INT))) AS k FROM events)"""

SQL["sigmoid_scores"] = with_(LONG, f"SELECT vec_id, label, {r('score')} AS score FROM long WHERE model = 'toxic'")

SQL["softmax_scores"] = with_([EMB], f"""SELECT vec_id, {r('h')} AS hate_score, CASE WHEN h > 0.5 THEN 'hate' ELSE 'non-hate' END AS hate_label,
  {r('c')} AS confidence FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE p END AS h,
    CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE greatest(p, 1 - p) END AS c
    FROM (SELECT vec_id, exp(12 * x[2] - 1) / (exp(12 * x[1]) + exp(12 * x[2] - 1)) AS p FROM emb))""")

SQL["label_list_to_map"] = with_(LONG, f"""SELECT vec_id, label, {r('score')} AS score FROM long WHERE model = 'target' AND vec_id % 8 <> 0
  UNION ALL SELECT vec_id, NULL, NULL FROM emb WHERE vec_id % 8 = 0""")

SQL["merge_categories"] = with_(LONG, f"SELECT vec_id, model || '_' || label AS category, {r('score')} AS score FROM long")

SQL["detect_issues"] = with_(SCORES, """SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1)::INT AS pos,
  printf('%s:%.3f', category, score) AS issue FROM issues""")

SQL["overall_toxicity"] = with_(SCORES, f"SELECT vec_id, {r('overall_toxicity')} AS overall_toxicity, is_toxic FROM scored")

SQL["hate_target"] = with_(SCORES, f"SELECT vec_id, hate_target, {r('hate_target_confidence')} AS hate_target_confidence FROM scored")

SQL["top_emotion"] = with_(LONG, f"""SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'unknown' ELSE label END AS emotion,
  CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE {r('score')} END AS emotion_score FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS k FROM long WHERE model = 'sentiment') WHERE k = 1""")

SQL["normalize_emotion"] = """SELECT event_id, CASE event_type WHEN 'view' THEN 'Happy' WHEN 'signup' THEN 'Angry' WHEN 'error' THEN 'Neutral'
  WHEN 'click' THEN 'calm' WHEN 'purchase' THEN 'Sad' END AS emotion FROM events"""

SQL["scrub_nonfinite"] = f"SELECT event_id, CASE WHEN event_id % 8 < 4 THEN 0.0 ELSE {r('value')} END AS value FROM events"

SQL["fallback_scores"] = with_(SEGS, f"""SELECT file, seg_idx, {r('overall_toxicity')} AS overall_toxicity, is_toxic, {r('neg / 2')} AS toxic_severe_toxic,
  {r('greatest(0.0, neg - 0.2)')} AS toxic_insult, {r('greatest(0.0, neg - 0.3)')} AS hate_hate, {r('neu')} AS hate_not_hate,
  {r('greatest(0.0, neg - 0.25)')} AS offensive_offensive, {r('pos')} AS sentiment_positive FROM segs""")

SQL["synthesize_intonation"] = with_(SEGS, "SELECT file, seg_idx, emotion, " + ", ".join(f"{r(c)} AS {c}" for c in _ACOUSTIC) + " FROM segs")

SQL["sarcasm_score"] = with_(SARCASM, f"SELECT vec_id, {r('sp')} AS sarcasm_probability, sn AS sarcasm_pattern FROM sar")

SQL["sarcasm_discount"] = with_(SARCASM, f"""SELECT vec_id, sp > 0.4 AS detected,
  {r('CASE WHEN sp > 0.4 THEN overall_toxicity * (1 - (0.3 + 0.5 * sp)) ELSE overall_toxicity END')} AS score,
  {r('CASE WHEN sp > 0.4 THEN 0.8 * sp ELSE 0.0 END')} AS confidence FROM sar""")

_HEUR = [*ACOUSTIC, *heuristic("acoustic", "hh", "vec_id % 11 <> 0")]
SQL["intonation_heuristic"] = with_(_HEUR, f"""SELECT vec_id, {r('h_score')} AS heuristic_score, {r('h_conf')} AS heuristic_certainty,
  h_n AS heuristic_factors FROM hh""")

SQL["adaptive_decision"] = with_(_HEUR, f"SELECT vec_id, h_score > 0.5 - 0.1 * h_conf AS is_extremist, {r('h_score')} AS extremist_probability FROM hh")

_OUT = [
    *SARCASM,
    "nulled AS (SELECT * REPLACE (CASE WHEN vec_id % 13 <> 0 THEN overall_toxicity END AS overall_toxicity) FROM acoustic)",
    *heuristic("nulled", "hn"),
    f"""two AS (SELECT vec_id, x, overall_toxicity AS t, h_score AS s, h_conf AS c, false AS sarcasm_on FROM hn
  UNION ALL SELECT vec_id, x, overall_toxicity, CASE WHEN sp > 0.4 THEN overall_toxicity * (1 - (0.3 + 0.5 * sp)) ELSE h_score END,
    CASE WHEN sp > 0.4 THEN 0.8 * sp ELSE h_conf END, true FROM hn JOIN (SELECT vec_id, sp FROM sar) USING (vec_id))""",
    f"""path AS (SELECT *, CASE WHEN t IS NULL THEN 'none' WHEN vec_id % 7 = 0 THEN 'silent' WHEN vec_id % 2 = 0 THEN 'model' ELSE 'heuristic' END AS way,
  CASE WHEN vec_id % 10 <> 0 THEN {sg(33)} END AS mp FROM two)""",
]
SQL["segment_outcome"] = with_(_OUT, f"""SELECT vec_id, sarcasm_on,
  {r("CASE way WHEN 'none' THEN 0.0 WHEN 'heuristic' THEN s ELSE t END")} AS extreme,
  CASE way WHEN 'model' THEN mp >= 0.4 WHEN 'heuristic' THEN s > 0.5 - 0.1 * c END AS is_extremist,
  {r("CASE way WHEN 'model' THEN mp WHEN 'heuristic' THEN s END")} AS extremist_probability, way = 'heuristic' AS heuristic_used,
  {r("CASE way WHEN 'heuristic' THEN c END")} AS heuristic_confidence FROM path""")

SQL["verdict_message"] = with_(DECIDED, f"""SELECT file, {MESSAGE} AS result FROM (SELECT * REPLACE (
    CASE d % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE total_segments END AS toxic_segments,
    CASE d % 4 WHEN 1 THEN true WHEN 2 THEN false END AS is_extremist_content)
  FROM (SELECT *, replace(file, 'doc_', '')::BIGINT AS d FROM roll))""")

_MM = [*SCORES, """mm AS (SELECT vec_id, model || '_' || label AS feature, score AS value FROM long
  UNION ALL SELECT vec_id, 'overall_toxicity', overall_toxicity FROM scored UNION ALL SELECT vec_id, 'is_toxic', is_toxic::INT::DOUBLE FROM scored
  UNION ALL SELECT vec_id, 'hate_target_confidence', hate_target_confidence FROM scored
  UNION ALL SELECT vec_id, 'hate_target_is_' || replace(lower(hate_target), ' ', '_'), 1.0 FROM scored WHERE hate_target IS NOT NULL
  UNION ALL SELECT vec_id, 'target_max_score', max(score) FROM long WHERE model = 'target' GROUP BY vec_id
  UNION ALL SELECT vec_id, 'num_detected_issues', count(category)::DOUBLE FROM emb LEFT JOIN issues USING (vec_id) GROUP BY vec_id)"""]
SQL["multimodel_features"] = with_(_MM, f"""SELECT vec_id, feature, {r('value')} AS value FROM mm
  UNION ALL SELECT vec_id, 'custom_score', 0.25 FROM emb""")

SQL["intonation_features"] = with_(ACOUSTIC, "SELECT vec_id, " + ", ".join(f"{r(c)} AS {c}" for c in _ACOUSTIC) + ", " + ", ".join(
    f"(CASE WHEN vec_id % 10 = 0 THEN 'neutral' ELSE emotion END = '{e}')::INT::DOUBLE AS emotion_is_{e}" for e in EMOTIONS) + " FROM acoustic")

_MATRIX = sorted(
    ["overall_toxicity", "is_toxic", "hate_target_confidence", "target_max_score", "num_detected_issues"]
    + [f"toxic_{x}" for x in TOXIC_LABELS] + ["hate_HATE", "hate_NOT-HATE", "offensive_offensive", "offensive_non-offensive"]
    + [f"sentiment_{x}" for x in ("negative", "neutral", "positive")] + [f"target_{x}" for x in TARGETS]
    + [f"hate_target_is_{x}" for x in TARGETS if "not" not in x])
SQL["feature_matrix"] = with_(_MM, "SELECT vec_id, " + ", ".join(
    f"coalesce(max({r('value')}) FILTER (feature = '{n}'), 0.0) AS \"{n}\"" for n in _MATRIX) + " FROM mm GROUP BY vec_id")

SQL["slice_audio"] = with_([EMB], f"""SELECT vec_id, len(y) AS n, {r('y[1]')} AS first, {r('coalesce(list_sum(y), 0.0)')} AS total FROM (
  SELECT vec_id, CASE WHEN b > a THEN x[a + 1:b] ELSE [] END AS y FROM (SELECT vec_id, x, greatest(0, trunc(s * 16)::INT) AS a,
    least(len(x), trunc(e * 16)::INT) AS b FROM (SELECT vec_id, x, 6 * {sg(40)} - 1 AS s, 6 * {sg(40)} - 1 + 3 * {sg(41)} AS e FROM emb)))""")

SQL["rms_energy"] = with_([EMB, """fr AS (SELECT vec_id, sqrt(sum(CASE WHEN i BETWEEN 1 AND 64 THEN x[i] * x[i] ELSE 0 END) / 16) AS e
  FROM emb, range(0, 17) f(k), range(0, 16) g(j), LATERAL (SELECT (k * 4 - 8 + j + 1)::INT AS i) GROUP BY vec_id, k)"""],
    f"SELECT vec_id, {r('avg(e)')} AS rms_mean, {r('max(e)')} AS rms_max FROM fr GROUP BY vec_id")

SQL["json_envelope"] = with_(DECIDED, """SELECT file, 0::BIGINT AS part, total_segments AS n_segments, true AS success, is_extremist_content AS is_extremist,
  first_text, last_text, total_segments, language FROM roll JOIN (
  SELECT file, arg_min(text, seg_idx) AS first_text, arg_max(text, seg_idx) AS last_text FROM lines GROUP BY file) USING (file)""")

# --- joins

SQL["align_nearest"] = f"""WITH p AS (SELECT hourly, user_id, event_id, event_type, epoch_us(CASE WHEN hourly THEN date_trunc('hour', ts) ELSE ts END) / 1000000 AS mid
  FROM events, (VALUES (false), (true)) h(hourly) WHERE event_type IN ('click', 'purchase')),
c AS (SELECT l.hourly, l.user_id, l.event_id, q.event_id AS right_idx, abs(l.mid - q.mid) AS distance,
  row_number() OVER (PARTITION BY l.hourly, l.event_id ORDER BY abs(l.mid - q.mid), q.event_id) AS k
  FROM p l JOIN p q ON l.hourly = q.hourly AND l.user_id = q.user_id AND l.event_type = 'click' AND q.event_type = 'purchase'
  WHERE abs(l.mid - q.mid) < 21600)
SELECT hourly, user_id, event_id, right_idx, {r('distance', 3)} AS distance FROM c WHERE k = 1"""

SQL["align_positional"] = with_(SEGS, f"""SELECT l.file, l.seg_idx, h.seg_idx IS NOT NULL AS has_acoustic, h.seg_idx AS heard_idx, {r('h.f0_mean')} AS heard_f0
  FROM segs l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seg_idx) - 1 AS place FROM segs WHERE num_words >= 4) h
  ON l.file = h.file AND l.seg_idx = h.place""")

SQL["lexicon_polarity"] = with_(polarity("documents", "text", "doc_id"),
                                "SELECT doc_id, " + ", ".join(f"{r(c)} AS {c}" for c in ("neg", "neu", "pos", "compound")) + " FROM pol")

SQL["broadcast_predictions"] = with_([NOTES], f"""SELECT comment_id, note_id, {r('rating')} AS rating, {r('m')} AS rating_by_id, (m >= 10)::INT AS pred
  FROM notes JOIN (SELECT comment_id, avg(rating) AS m FROM notes GROUP BY comment_id) USING (comment_id)""")

SQL["fill_labels"] = with_(FILLED, "SELECT row_id, label, pred, label_filled FROM filled")

SQL["compare_versions"] = with_(FILLED, f"""SELECT count(*) AS n_rows, count(*) FILTER (row_id % 9 <> 0) AS n_match,
  {r('count(*) FILTER (row_id % 9 <> 0) * 100.0 / count(*)')} AS match_percent FROM filled WHERE label IS NULL""")

# --- aggregations

SQL["transcript_stats"] = with_(JOINED, f"""SELECT file, count(*) FILTER (NOT is_blank) AS total_segments, count(*) FILTER (NOT is_blank AND is_toxic) AS toxic_segments,
  {r('coalesce(avg(overall_toxicity) FILTER (NOT is_blank), 0)')} AS avg_toxicity,
  {r('coalesce(max(overall_toxicity) FILTER (NOT is_blank), 0)')} AS max_toxicity, any_value(language) AS language FROM js GROUP BY file""")

SQL["hate_stats"] = with_(JOINED, f"""SELECT file, count(*) AS total_segments, count(*) FILTER (h > 0.5) AS hate_segments, {r('avg(h)')} AS avg_hate_score,
  {r('max(h)')} AS max_hate_score, any_value(language) AS language FROM (
  SELECT *, exp(12 * x[2] - 1) / (exp(12 * x[1]) + exp(12 * x[2] - 1)) AS h FROM js WHERE NOT is_blank) GROUP BY file""")

_FREQ = [*JOINED, "freq AS (SELECT file, category, count(*) AS n FROM js JOIN issues USING (vec_id) WHERE NOT is_blank GROUP BY file, category)"]
SQL["issue_frequency"] = with_(_FREQ, "SELECT file, category, n FROM freq")

SQL["document_scores"] = with_(polarity("documents", "text", "doc_id"),
                               f"""SELECT 'doc_' || doc_id AS file, {r(clamp('0.8 * neg + 0.2 * (1 - neu)', 0, 1))} AS overall_toxicity, neg > 0.6 AS is_toxic FROM pol""")

SQL["recording_rollup"] = with_(DECIDED, f"SELECT {ROLL_ROUNDED} FROM roll")

SQL["file_prediction_rollup"] = with_(JOINED, f"""SELECT file, count(*) AS total_segments, count(*) FILTER (p >= 0.4) AS extremist_segments,
  count(*) FILTER (p < 0.4) AS non_extremist_segments, {r('count(*) FILTER (p >= 0.4) / count(*)')} AS extremist_ratio,
  {r('avg(p)')} AS avg_extremist_probability, {r('coalesce(sum(p) FILTER (p >= 0.4), 0) / count(*)')} AS weighted_extremist_score,
  coalesce(sum(p) FILTER (p >= 0.4), 0) / count(*) > 0.3 AS is_extremist_content FROM (SELECT file, overall_toxicity AS p FROM js) GROUP BY file""")

SQL["annotator_rollup"] = with_([NOTES], f"""SELECT comment_id, {r('avg(rating)')} AS rating, {r('avg(k)')} AS k, {r('avg(label)')} AS label,
  arg_min(kind, note_id) FILTER (kind IS NOT NULL) AS kind FROM notes GROUP BY comment_id""")

SQL["group_targets"] = with_([NOTES], f"""SELECT comment_id, {r('avg(rating)')} AS rating, {r('avg(k)')} AS k, {r('avg(label)')} AS label_mean,
  count(label) > 0 AS is_labeled, CASE WHEN count(label) > 0 THEN (avg(label) >= 0.5)::INT END AS target FROM notes GROUP BY comment_id""")


def _profile(table: str, column: str, numeric: bool) -> str:
    if numeric:
        return f"""SELECT '{column}' AS "column", true AS is_numeric, count(*) AS n_rows, NULL::BIGINT AS n_distinct, NULL::DOUBLE AS distinct_ratio,
  NULL::DOUBLE AS mean_length, 'numeric' AS role, NULL::VARCHAR AS method FROM {table}"""
    return f"""SELECT '{column}', false, count(*), count(DISTINCT {column}), {r(f'count(DISTINCT {column}) / count(*)')}, {r(f'avg(length({column}))')},
  CASE WHEN count(DISTINCT {column}) <= 1000 AND count(DISTINCT {column}) / count(*) <= 0.2 AND avg(length({column})) <= 50
    THEN 'categorical' ELSE 'ignored' END, 'exact' FROM {table}"""


SQL["profile_columns"] = "\nUNION ALL ".join(
    [_profile("orders", c, c in ("o_orderkey", "o_custkey", "o_totalprice"))
     for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")]
    + [_profile("documents", c, c in ("doc_id", "n_chars")) for c in ("doc_id", "text", "lang", "source", "n_chars")])

SQL["class_balance"] = f"""WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic),
t AS (SELECT count(*) AS k, sum(n)::BIGINT AS total, min(n) AS low FROM c)
SELECT label, n, total AS n_rows, {r('total / (k * n)')} AS weight, k < 2 OR low < 2 OR total < 6 AS too_small FROM c, t"""

SQL["prediction_rates"] = with_(FILLED, f"""SELECT {r('avg(label)')} AS labeled_rate, {r('avg(pred) FILTER (label IS NULL)')} AS predicted_rate FROM filled""")

SQL["labeling_progress"] = f"""SELECT count(*) AS labeled, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (toxic <> 1 AND quality = 1) AS not_flagged,
  count(*) FILTER (toxic <> 1 AND quality <> 1) AS skipped, {r('count(*) / (SELECT count(*) FROM documents) * 100')} AS percent_done FROM labels"""

SQL["contour_summary"] = f"""WITH v AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::DOUBLE AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE event_id % 6 <> 0)
SELECT user_id, coalesce(n_valid, 0) AS n_valid, {", ".join(f"coalesce({r(c, 5)}, 0.0) AS {c}" for c in
    ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_slope", "f0_final"))}
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS n_valid, avg(value) AS f0_mean, stddev_pop(value) AS f0_std,
  min(value) AS f0_min, max(value) AS f0_max, max(value) - min(value) AS f0_range,
  CASE WHEN count(*) > 1 THEN regr_slope(value, x) END AS f0_slope, avg(value) FILTER (back <= 25) AS f0_final FROM v GROUP BY user_id) USING (user_id)"""

SQL["impute"] = with_([NOTES], f"""SELECT note_id, {r('coalesce(rating, (SELECT quantile_cont(rating, 0.5) FROM notes))')} AS rating,
  coalesce(kind, (SELECT kind FROM notes WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM notes""")

SQL["standardize"] = with_([EMB], "SELECT vec_id, " + ", ".join(
    r(f"(x[{i}] - avg(x[{i}]) OVER ()) / stddev_pop(x[{i}]) OVER ()") + f" AS d{i}" for i in range(1, 65)) + ", 0.0::DOUBLE AS flat FROM emb")

# --- windows, splits, metrics

_RANKED = """ranked AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '_42')) AS k,
  row_number() OVER (ORDER BY md5(doc_id || '_42')) AS a, count(*) OVER (PARTITION BY toxic) AS n FROM labels)"""
SQL["stratified_split"] = with_([_RANKED], "SELECT doc_id, toxic, CASE WHEN k <= round(n * 0.2) THEN 'validation' ELSE 'train' END AS part FROM ranked")

SQL["kfold_assign"] = with_([_RANKED], """SELECT doc_id, toxic, ((k - 1) % least(5, greatest(2, (SELECT min(n) FROM ranked))))::INT AS fold,
  ((a - 1) % 5)::INT AS plain_fold FROM ranked""")

_GRID = ", ".join(f"({round(0.05 * i, 2)}::DOUBLE)" for i in range(1, 20))
SQL["threshold_sweep"] = with_([*BOTH, f"""cand AS (SELECT DISTINCT variant, score AS t FROM both_sl UNION
  SELECT variant, g FROM (VALUES {_GRID}) grid(g), (VALUES ('exact'), ('tied')) v(variant))""",
    """fb AS (SELECT c.variant, t, coalesce(5.0 * count(*) FILTER (score >= t AND y = 1) / nullif(5.0 * count(*) FILTER (score >= t AND y = 1)
  + 4.0 * count(*) FILTER (score < t AND y = 1) + count(*) FILTER (score >= t AND y = 0), 0), 0) AS f
  FROM cand c JOIN both_sl b ON b.variant = c.variant GROUP BY c.variant, t)"""],
    f"""SELECT variant, {r('t')} AS threshold, {r('f')} AS fbeta FROM (
  SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f DESC, t) AS k FROM fb) WHERE k = 1""")

SQL["prevalence_threshold"] = with_([
    *SL, "part_sl AS (SELECT score, CASE WHEN vec_id % 3 <> 0 THEN y END AS y FROM sl)",
    """kinds AS (SELECT CASE WHEN y IS NULL THEN 'unlabelled' ELSE 'labelled' END AS quantile_over, list(score ORDER BY score) AS l,
  (SELECT avg(y) FROM part_sl) AS p FROM part_sl GROUP BY 1)""",
    "spot AS (SELECT *, (len(l) - 1) * (1 - p) AS h FROM kinds)"],
    f"""SELECT quantile_over, {r('p')} AS positive_rate,
  {r('l[floor(h)::INT + 1] + (l[ceil(h)::INT + 1] - l[floor(h)::INT + 1]) * (h - floor(h))')} AS threshold FROM spot""")

SQL["roc_auc"] = with_(BOTH, f"""SELECT variant, {r("avg(CASE WHEN p > n THEN 1 WHEN p = n THEN 0.5 ELSE 0 END)")} AS roc_auc FROM (
  SELECT a.variant, a.score AS p, b.score AS n FROM both_sl a JOIN both_sl b ON a.variant = b.variant AND a.y = 1 AND b.y = 0) GROUP BY variant""")

SQL["average_precision"] = with_([*BOTH, "g AS (SELECT variant, score, sum(y) AS p, count(*) AS n FROM both_sl GROUP BY variant, score)",
    "cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (PARTITION BY variant ORDER BY score DESC))"],
    f"SELECT variant, {r('sum(p * tp / al) / sum(p)')} AS average_precision FROM cum GROUP BY variant")

SQL["segment_timeline"] = with_(SEGS, f"SELECT file, seg_idx, {r('start_s')} AS start_s, {r('end_s')} AS end_s FROM segs")

# --- sorts, limits, sets

SQL["top_issues"] = with_(_FREQ, """SELECT file, rank, category, n FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, category)::INT AS rank FROM freq) WHERE rank <= 10""")

SQL["head_rows"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100"

SQL["stack_classes"] = with_(SEGS, f"SELECT file, seg_idx, {r('overall_toxicity')} AS overall_toxicity, {r('f0_mean')} AS f0_mean, (doc_id % 2)::INT AS label FROM segs")

SQL["distinct_candidates"] = with_(SL, f"SELECT round(score, 2) AS threshold FROM sl UNION SELECT g FROM (VALUES {_GRID}) grid(g)")

# --- evaluation and composed jobs

SQL["one_hot"] = "SELECT o_orderkey, " + ", ".join(
    f"(o_orderpriority = '{v}')::INT::DOUBLE AS \"o_orderpriority_{v}\"" for v in
    ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders"

SQL["classification_report"] = with_([*SL, """pc AS (SELECT c, count(*) FILTER (pred = c AND y = c) / count(*) FILTER (pred = c) AS p,
  count(*) FILTER (pred = c AND y = c) / count(*) FILTER (y = c) AS rc, count(*) FILTER (y = c) AS s FROM sl, (VALUES (0), (1)) k(c) GROUP BY c)""",
    "pf AS (SELECT *, 2 * p * rc / (p + rc) AS f FROM pc)"],
    f"""SELECT 'class_' || c AS name, {r('p')} AS precision, {r('rc')} AS recall, {r('f')} AS f1, s AS support FROM pf
  UNION ALL SELECT 'accuracy', NULL, NULL, {r('avg((pred = y)::INT)')}, count(*) FROM sl
  UNION ALL SELECT 'macro avg', {r('avg(p)')}, {r('avg(rc)')}, {r('avg(f)')}, sum(s)::BIGINT FROM pf
  UNION ALL SELECT 'weighted avg', {r('sum(p * s) / sum(s)')}, {r('sum(rc * s) / sum(s)')}, {r('sum(f * s) / sum(s)')}, sum(s)::BIGINT FROM pf""")

SQL["confusion_matrix"] = with_(SL, """SELECT y AS actual, count(*) FILTER (pred = 0) AS predicted_0, count(*) FILTER (pred = 1) AS predicted_1
  FROM sl GROUP BY y""")

_REG = f"count(*) AS n, {r('sqrt(avg((y - p) ** 2))', 4)} AS rmse, {r('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 4)} AS r2"
SQL["regression_metrics"] = f"""WITH e AS (SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p, (l_orderkey % 5)::INT AS fold FROM lineitem)
SELECT {_REG}, fold FROM e GROUP BY fold UNION ALL SELECT {_REG}, -1 FROM e"""

SQL["score_with_lexicon"] = with_(polarity("documents", "text", "doc_id"), f"""SELECT doc_id, {r(clamp('0.8 * neg + 0.2 * (1 - neu)', 0, 1))} AS overall_toxicity,
  neg > 0.6 AS is_toxic, {r('neg')} AS toxic, {r('neg / 2')} AS severe_toxic, 0.0::DOUBLE AS obscene, 0.0::DOUBLE AS threat,
  {r('greatest(0.0, neg - 0.2)')} AS insult, 0.0::DOUBLE AS identity_hate FROM pol""")

SQL["score_recordings"] = with_(DECIDED, f"SELECT {ROLL_ROUNDED}, {MESSAGE} AS result FROM roll")

_WHOLE = [
    f"""tok_d AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS term FROM documents)""",
    """sums_d AS (SELECT doc_id, sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0 END) AS p, sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0 END) AS n,
  count(*) FILTER (coalesce(valence, 0) = 0) AS u FROM tok_d LEFT JOIN lex USING (term) WHERE term <> '' GROUP BY doc_id)"""]

SQL["score_transcripts"] = with_([
    *SEGS, *_WHOLE,
    """seg_stats AS (SELECT file, count(*) FILTER (NOT is_blank) AS total_segments, count(*) FILTER (is_toxic) AS toxic_segments,
  coalesce(avg(overall_toxicity), 0) AS a, coalesce(max(overall_toxicity), 0) AS m, any_value(language) AS language FROM segs GROUP BY file)"""],
    f"""SELECT file, {r(clamp('0.8 * coalesce(n / (p + n + u), 0) + 0.2 * (1 - coalesce(u / (p + n + u), 0))', 0, 1))} AS overall_toxicity,
  coalesce(n / (p + n + u), 0) > 0.6 AS is_toxic, {r('a')} AS avg_segment_toxicity, {r('m')} AS max_segment_toxicity, total_segments, toxic_segments, language
  FROM documents LEFT JOIN sums_d USING (doc_id) JOIN seg_stats ON file = 'doc_' || doc_id""")

SQL["process_directory"] = """SELECT count(*) AS total, count(*) FILTER (doc_id % 13 <> 0 AND doc_id % 5 <> 0) AS processed,
  count(*) FILTER (doc_id % 13 <> 0 AND doc_id % 5 = 0) AS skipped, count(*) FILTER (doc_id % 13 = 0) AS failed FROM documents"""

SQL["reload_written_results"] = with_([*DECIDED, *_WHOLE], f"""SELECT file, true AS valid, {MESSAGE} AS result, is_extremist_content AS is_extremist,
  total_segments AS n_segments, {r('max_toxicity')} AS max_toxicity,
  {r(clamp('0.8 * coalesce(n / (p + n + u), 0) + 0.2 * (1 - coalesce(u / (p + n + u), 0))', 0, 1))} AS full_text_toxicity,
  coalesce(n / (p + n + u), 0) > 0.6 AS full_text_toxic
  FROM documents LEFT JOIN sums_d USING (doc_id) JOIN roll ON file = 'doc_' || doc_id WHERE doc_id % 13 <> 0""")

# --- learning: what is determined whatever the fitted numbers

SQL["top_features"] = "SELECT DISTINCT f AS feature FROM embeddings, (VALUES ('d00'), ('d01')) first_two(f)"

SQL["fill_missing_labels"] = f"""SELECT count(*) AS n_rows, count(*) FILTER (toxic IS NULL) AS n_missing, count(toxic) AS n_kept,
  count(*) FILTER (toxic IS NULL) AS n_predicted, {r('avg(toxic)')} AS positive_rate, true AS rate_matched FROM documents LEFT JOIN labels USING (doc_id)"""


def _ranked_rows(source: str, key: str, label: str) -> str:
    return f"""SELECT {key}, {label}, count(*) OVER (PARTITION BY {label}) AS n,
  row_number() OVER (PARTITION BY {label} ORDER BY md5({key}::VARCHAR || '_42')) AS k FROM {source}"""


SQL["small_data_guard"] = with_([*SL, f"rr AS ({_ranked_rows('sl', 'vec_id', 'y')})"], """SELECT 'all' AS rows, y AS label,
  count(*) FILTER (k <= round(n * 0.2)) AS n_held_out, false AS guarded FROM rr GROUP BY y
  UNION ALL SELECT 'one_class', 1, count(*), true FROM sl WHERE y = 1""")

_SPLIT = [*SL, f"held AS ({_ranked_rows('sl', 'vec_id', 'y')})"]
SQL["train_forest"] = SQL["train_boosted"] = SQL["train_logistic"] = with_(
    _SPLIT, "SELECT vec_id, y AS label, true AS is_probability, true AS ranks_well FROM held WHERE k <= round(n * 0.2)")
SQL["predict_segments"] = with_(_SPLIT, "SELECT vec_id, k <= round(n * 0.2) AS held_out, true AS cut_apart, true AS ranks_well FROM held")

SQL["cross_validate"] = with_([*SL, f"rr AS ({_ranked_rows('sl', 'vec_id', 'y')})"], """SELECT vec_id, y AS label,
  ((k - 1) % least(5, greatest(2, (SELECT min(n) FROM rr))))::INT AS fold, true AS scored FROM rr""")

_FOLDED = [*SL, "fsl AS (SELECT (vec_id % 5)::INT AS fold, score, y FROM sl)",
           "fg AS (SELECT fold, score, sum(y) AS p, count(*) AS n FROM fsl GROUP BY fold, score)",
           "fcum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM fg WINDOW w AS (PARTITION BY fold ORDER BY score DESC))",
           "fap AS (SELECT fold, sum(p * tp / al) / sum(p) AS ap FROM fcum GROUP BY fold)",
           """fauc AS (SELECT a.fold, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
  FROM fsl a JOIN fsl b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold)""",
           "facc AS (SELECT fold, avg((y = (score >= 0.5)::INT)::INT) AS accuracy, count(*) AS n FROM fsl GROUP BY fold)"]
SQL["fold_report"] = with_(_FOLDED, f"""SELECT fold, {r('accuracy')} AS accuracy, n, {r('auc')} AS roc_auc, {r('ap')} AS average_precision
  FROM facc JOIN fauc USING (fold) JOIN fap USING (fold)""")
SQL["fold_summary"] = with_([*_FOLDED, "ag AS (SELECT score, sum(y) AS p, count(*) AS n FROM sl GROUP BY score)",
                             "acum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM ag WINDOW w AS (ORDER BY score DESC))"],
    f"""SELECT count(*) AS n_folds, {r('avg(accuracy)')} AS mean_accuracy, {r('stddev_pop(accuracy)')} AS std_accuracy,
  (SELECT {r('avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)')} FROM sl a JOIN sl b ON a.y = 1 AND b.y = 0) AS roc_auc,
  (SELECT {r('sum(p * tp / al) / sum(p)')} FROM acum) AS average_precision FROM facc""")

SQL["model_bundle"] = "SELECT vec_id, true AS same_probability, true AS same_flag FROM embeddings"

_HELD = "\nUNION ALL ".join(f"SELECT row_id, toxic AS label, '{mode}' AS mode, true AS ranks_well FROM (" + _ranked_rows(
    f"(SELECT doc_id AS row_id, toxic FROM documents JOIN labels USING (doc_id) WHERE length(text) <= {most})", "row_id", "toxic")
    + ") WHERE k <= round(n * 0.2)" for mode, most in (("text_only", "1e9"), ("model", "20000")))
SQL["train_from_labels"] = _HELD

_HITS = " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in ("idiot", "scum", "trash", "moron"))
SQL["score_texts"] = f"""SELECT doc_id, {r('CASE WHEN length(text) <= 20000 THEN (least(1.0, n / 4) + n / (n + 1)) / 2 END')} AS overall_toxicity,
  {r('CASE WHEN length(text) <= 20000 THEN least(1.0, n / 4) END')} AS toxic, {r('CASE WHEN length(text) <= 20000 THEN n / (n + 1) END')} AS hate,
  CASE WHEN length(text) > 20000 THEN 'ValueError' END AS error_type, CASE WHEN length(text) > 20000 THEN 'too long' END AS error_message
  FROM (SELECT doc_id, text, {_HITS} AS n FROM documents)"""

SQL["lexicon_polarity_joined"] = f"""WITH t AS (SELECT doc_id, length(term) % 9 - 4 AS v FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS term FROM documents) WHERE term <> ''),
s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END)::DOUBLE AS n,
  count(*) FILTER (v = 0)::DOUBLE AS u, sum(v)::DOUBLE AS c FROM t GROUP BY doc_id),
d AS (SELECT doc_id, p, n, u, c FROM documents LEFT JOIN s USING (doc_id))
SELECT CASE WHEN named THEN doc_id END AS doc_id, {r('coalesce(n / (p + n + u), 0)')} AS neg, {r('coalesce(u / (p + n + u), 0)')} AS neu,
  {r('coalesce(p / (p + n + u), 0)')} AS pos, {r('coalesce(c / sqrt(c * c + 15), 0)')} AS compound FROM d, (VALUES (true), (false)) w(named)"""


_PAIRED = [*SEGS, "classes AS (SELECT doc_id, coalesce(max(toxic), 0) AS label FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id)",
           """near AS (SELECT c.label || '/' || l.file AS file, l.seg_idx, c.label::INT AS label, l.overall_toxicity, l.is_toxic, l.neg, l.pos,
  h.f0_mean, h.duration, h.emotion, row_number() OVER (PARTITION BY l.file, l.seg_idx ORDER BY
    abs((l.start_s + l.end_s) / 2 - (h.start_s + 0.37 + h.end_s + 0.37) / 2), h.seg_idx) AS k
  FROM segs l JOIN segs h ON l.file = h.file AND h.seg_idx % 3 < 2 JOIN classes c ON c.doc_id = l.doc_id
  WHERE l.doc_id % 17 <> 0 AND l.doc_id % 19 <> 0 AND l.doc_id % 23 <> 0
    AND abs((l.start_s + l.end_s) / 2 - (h.start_s + 0.37 + h.end_s + 0.37) / 2) < 0.5)""",
           "al AS (SELECT *, file || '#' || seg_idx AS row FROM near WHERE k = 1)",
           f"ra AS ({_ranked_rows('al', 'row', 'label')})"]
SQL["train_from_pairs"] = with_(_PAIRED, f"""SELECT file, seg_idx, label, 36 AS n_features, ra.k <= round(n * 0.2) AS held_out,
  {r('coalesce(overall_toxicity, 0)')} AS overall_toxicity, is_toxic::INT::DOUBLE AS is_toxic, {r('neg')} AS toxic_toxic,
  {r('greatest(0.0, neg - 0.3)')} AS "hate_HATE", {r('pos')} AS sentiment_positive, 0.25::DOUBLE AS custom_score,
  {r('f0_mean')} AS f0_mean, {r('duration')} AS duration, (emotion = 'happy')::INT::DOUBLE AS emotion_is_happy FROM al JOIN ra USING (row, label)""")
SQL["predict_pairs"] = with_(_PAIRED, """SELECT file, count(*) AS total_segments, true AS adds_up, true AS decided, true AS ranks_well
  FROM al GROUP BY file""")
SQL["broken_pair_members"] = """SELECT coalesce(toxic, 0) || '/doc_' || doc_id AS file, 'multimodel' AS file_type, 'JSONDecodeError' AS error_type,
  'Failed to parse JSON file' AS error_message FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 17 = 0"""

SQL["acoustic_rows"] = with_([*LONG, """sam AS (SELECT vec_id // 50 AS rec, (vec_id % 50) * 64 + i - 1 AS place, x[i] AS v FROM emb, range(1, 65) t(i))""",
    "ends AS (SELECT rec, max(place) + 1 AS n FROM sam GROUP BY rec)",
    """sg AS (SELECT vec_id, vec_id // 50 AS rec, vec_id % 50 * 0.064::DOUBLE + 0.2::DOUBLE * x[1] AS s,
  vec_id % 50 * 0.064::DOUBLE + 0.2::DOUBLE * x[1] + 0.15::DOUBLE + 2 * x[2] AS e FROM emb)""",
    """cut AS (SELECT *, greatest(0, trunc(s * 1000)::BIGINT) AS a, least(n, trunc(e * 1000)::BIGINT) AS b
  FROM sg JOIN ends USING (rec) WHERE e > s AND e - s >= 0.1)""",
    """fr AS (SELECT vec_id, k, sqrt(coalesce(sum(v * v), 0) / 25) AS level FROM (
  SELECT *, unnest(range(0, (b - a - 1) // 10 + 1)) AS k FROM cut WHERE b - a >= 120) c
  LEFT JOIN sam ON sam.rec = c.rec AND place >= greatest(a, a + k * 10 - 12) AND place < least(b, a + k * 10 + 13) GROUP BY vec_id, k)""",
    "rms AS (SELECT vec_id, avg(level) AS rms_mean, max(level) AS rms_max FROM fr GROUP BY vec_id)",
    """pts AS (SELECT vec_id, 100 + 200 * x[i] AS v, (row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1)::DOUBLE AS place,
  row_number() OVER (PARTITION BY vec_id ORDER BY i DESC) AS back FROM emb, range(1, 65) t(i) WHERE x[i] > 0)""",
    """pitch AS (SELECT vec_id, avg(v) AS f0_mean, stddev_pop(v) AS f0_std, min(v) AS f0_min, max(v) AS f0_max, max(v) - min(v) AS f0_range,
  CASE WHEN count(*) > 1 THEN regr_slope(v, place) END AS f0_slope, avg(v) FILTER (back <= 25) AS f0_final FROM pts GROUP BY vec_id)""",
    """mood AS (SELECT vec_id, label, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS k
  FROM long WHERE model = 'sentiment' AND vec_id % 7 <> 0)"""],
    f"""SELECT 'rec_' || rec AS file, (vec_id % 50)::INT AS seg_idx, {r('s', 5)} AS start_s, {r('e', 5)} AS end_s, {r('e - s', 5)} AS duration,
  'x' AS text, coalesce(label, 'unknown') AS emotion, {r('coalesce(score, 0)', 5)} AS emotion_score, """ + ", ".join(
        f"{r(f'CASE WHEN b - a >= 200 THEN coalesce({c}, 0) ELSE 0 END', 5)} AS {c}"
        for c in ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_slope", "f0_final"))
    + f""", {r('coalesce(rms_mean, 0)', 5)} AS rms_mean, {r('coalesce(rms_max, 0)', 5)} AS rms_max
  FROM cut LEFT JOIN rms USING (vec_id) LEFT JOIN pitch USING (vec_id) LEFT JOIN (SELECT * FROM mood WHERE k = 1) USING (vec_id) WHERE b > a""")

_PARTS = """parts AS (SELECT fold AS part, * FROM oof UNION ALL SELECT -1, * FROM oof)"""
SQL["fill_report"] = with_([EMB, """xs AS (SELECT vec_id, x[1] AS a, x[2] AS b, (x[1] + 1.5 * x[2] > 0.1)::INT::DOUBLE AS y,
  ((row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '_42')) - 1) % 5)::INT AS fold FROM emb)""",
    """fit AS (SELECT f.fold, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
  corr(a, b) * count(*) AS g, covar_pop(a, y) / stddev_pop(a) * count(*) AS ca, covar_pop(b, y) / stddev_pop(b) * count(*) AS cb
  FROM xs JOIN (SELECT DISTINCT fold FROM xs) f ON xs.fold <> f.fold GROUP BY f.fold)""",
    """oof AS (SELECT xs.fold, y, my + ((n + 3) * ca - g * cb) / ((n + 3) ** 2 - g * g) * (a - ma) / sa
    + ((n + 3) * cb - g * ca) / ((n + 3) ** 2 - g * g) * (b - mb) / sb AS p FROM xs JOIN fit USING (fold))""",
    _PARTS,
    """auc AS (SELECT u.part, avg(CASE WHEN u.p > v.p THEN 1 WHEN u.p = v.p THEN 0.5 ELSE 0 END) AS auc
  FROM parts u JOIN parts v ON u.part = v.part AND u.y = 1 AND v.y = 0 GROUP BY u.part)""",
    """ap AS (SELECT part, sum(hit * tp / al) / sum(hit) AS ap FROM (SELECT part, y AS hit, sum(y) OVER w AS tp, count(*) OVER w AS al
  FROM parts WINDOW w AS (PARTITION BY part ORDER BY p DESC)) GROUP BY part)"""],
    f"""SELECT CASE WHEN part >= 0 THEN part END AS fold, n, rmse, r2, {r('auc', 5)} AS roc_auc, {r('ap', 5)} AS average_precision FROM (
  SELECT part, count(*) AS n, {r('sqrt(avg((y - p) ** 2))', 5)} AS rmse, {r('1 - avg((y - p) ** 2) / var_pop(y)', 5)} AS r2 FROM parts GROUP BY part)
  JOIN auc USING (part) JOIN ap USING (part)""")

SQL["fill_evaluated"] = with_([f"lr AS ({_ranked_rows('(SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id))', 'doc_id', 'toxic')})",
    """fl AS (SELECT 'logistic' AS kind, ((k - 1) % least(5, greatest(2, (SELECT min(n) FROM lr))))::INT AS fold FROM lr
  UNION ALL SELECT 'ridge', ((row_number() OVER () - 1) % 5)::INT FROM lr)"""],
    """SELECT kind, fold, count(*) AS n, true AS measured FROM fl GROUP BY kind, fold
  UNION ALL SELECT kind, NULL, count(*), true FROM fl GROUP BY kind""")
