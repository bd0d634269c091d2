"""Column functions on classifier outputs: heads, merged categories, toxicity, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MODELS
from ..settings import DEFAULTS, TOXIC_LABELS, Settings
from .text import clamp, decimals, is_blank


def empty_scores() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sigmoid_scores(logits: Column, labels: list[str]) -> Column:
    """Independent probabilities of a multi-label head, keyed by label."""
    return F.map_from_arrays(F.array(*map(F.lit, labels)), F.transform(logits, sigmoid))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def softmax_map(logits: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, labels)), softmax(logits))


def softmax_scores(logits: Column, text: Column) -> Column:
    """Struct(hate_score, hate_label, confidence) of a two-class head; zeros for blank text."""
    probabilities = softmax(logits)
    hate = F.when(is_blank(text), F.lit(0.0)).otherwise(probabilities[1])
    return F.struct(
        hate.alias("hate_score"),
        F.when(hate > 0.5, "hate").otherwise("non-hate").alias("hate_label"),
        F.when(is_blank(text), F.lit(0.0)).otherwise(F.array_max(probabilities)).alias("confidence"),
    )


def label_list_to_map(entries: Column) -> Column:
    """Array of (label, score) to a map; an absent list becomes an empty map."""
    return F.coalesce(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["label"], e["score"].cast("double")))),
        empty_scores(),
    )


def prefixed(scores: Column, prefix: str) -> Column:
    """The map with a prefix on every key; null counts as empty."""
    return F.transform_keys(F.coalesce(scores, empty_scores()), lambda k, v: F.concat(F.lit(prefix), k))


def merge_categories(outputs: Column) -> Column:
    """All model maps as one map whose keys carry the model name."""
    return F.map_concat(*[prefixed(outputs[m], f"{m}_") for m in MODELS])


def detect_issues(categories: Column, settings: Settings = DEFAULTS) -> Column:
    """Array of (category, score) above the threshold, skip words left out, in model order."""
    def wanted(entry: Column) -> Column:
        name = F.lower(entry["key"])
        keep = entry["value"] > settings.toxicity_threshold
        for token in settings.issue_skip:
            keep = keep & ~name.contains(token)
        return keep

    return F.transform(
        F.filter(F.map_entries(categories), wanted),
        lambda e: F.struct(e["key"].alias("category"), e["value"].alias("score")))


def issue_text(issues: Column) -> Column:
    return F.transform(issues, lambda i: F.concat(i["category"], F.lit(":"), decimals(i["score"], 3)))


def overall_toxicity(categories: Column) -> Column:
    """Mean of the three highest harmful scores; absent scores are left out, none gives 0."""
    names = [f"toxic_{label}" for label in TOXIC_LABELS] + ["hate_HATE", "offensive_offensive"]
    present = F.array_compact(F.array(*[F.try_element_at(categories, F.lit(n)) for n in names]))
    top = F.slice(F.sort_array(present, asc=False), 1, 3)
    total = F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.size(top), F.lit(1))


def best_entry(entries: Column) -> Column:
    """Highest-valued map entry, the first one on ties."""
    ranked = F.transform(
        entries,
        lambda e, i: F.struct(e["value"].alias("score"), (-i).alias("rank"), e["key"].alias("label")))
    return F.array_max(ranked)


def hate_target(targets: Column, toxicity: Column, settings: Settings = DEFAULTS) -> Column:
    """Struct(target, confidence); null target unless the text is toxic and some target is likely."""
    likely = F.map_filter(
        F.coalesce(targets, empty_scores()),
        lambda k, v: ~F.lower(k).contains("not") & (v > settings.target_floor))
    best = F.when(toxicity > settings.toxicity_threshold, best_entry(F.map_entries(likely)))
    return F.struct(
        F.initcap(F.translate(best["label"], "_-", "  ")).alias("target"),
        F.coalesce(best["score"], F.lit(0.0)).alias("confidence"),
    )


def top_emotion(scores: Column) -> Column:
    """Struct(emotion, emotion_score): best label, or unknown/0 when there is none."""
    best = best_entry(F.map_entries(scores))
    return F.struct(
        F.coalesce(best["label"], F.lit("unknown")).alias("emotion"),
        F.coalesce(best["score"], F.lit(0.0)).alias("emotion_score"),
    )


def with_classification(df: DataFrame, outputs: str = "model_outputs", settings: Settings = DEFAULTS) -> DataFrame:
    """Every derived field of a text classification, given the five model maps.

    Each step reads the columns of the step before, so shared parts are computed once per row.
    """
    return (
        df.withColumn("categories", merge_categories(F.col(outputs)))
        .withColumn("overall_toxicity", overall_toxicity(F.col("categories")))
        .withColumns({
            "is_toxic": F.col("overall_toxicity") > settings.toxicity_threshold,
            "detected_issues": detect_issues(F.col("categories"), settings),
            "_target": hate_target(F.col(outputs)["target"], F.col("overall_toxicity"), settings)})
        .withColumns({"hate_target": F.col("_target.target"), "hate_target_confidence": F.col("_target.confidence")})
        .drop("_target")
    )


def fallback_scores(neg: Column, neu: Column, pos: Column) -> dict[str, Column]:
    """Classification built from sentiment shares alone, for runs without a model scorer."""
    zero = F.lit(0.0)

    def scores(**values: Column) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])

    return {
        "overall_toxicity": clamp(neg * 0.8 + (1 - neu) * 0.2, 0.0, 1.0),
        "is_toxic": neg > 0.6,
        "hate_target": F.lit(None).cast("string"),
        "hate_target_confidence": zero,
        "model_outputs": F.struct(
            scores(toxic=neg, severe_toxic=neg * 0.5, obscene=zero, threat=zero,
                   insult=F.greatest(zero, neg - 0.2), identity_hate=zero).alias("toxic"),
            scores(**{"HATE": F.greatest(zero, neg - 0.3), "NOT-HATE": neu}).alias("hate"),
            scores(**{"offensive": F.greatest(zero, neg - 0.25), "non-offensive": neu}).alias("offensive"),
            scores(negative=neg, neutral=neu, positive=pos).alias("sentiment"),
            empty_scores().alias("target"),
        ),
        "detected_issues": F.array().cast("array<struct<category:string,score:double>>"),
    }
