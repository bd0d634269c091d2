"""Plug-in batch scoring of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scores import empty_scores, fallback_scores
from ..functions.text import is_blank
from ..schemas import ERROR, MODEL_OUTPUTS, MODELS
from ..settings import DEFAULTS, Settings
from .lexicon import lexicon_polarity

# A scorer takes a list of texts and returns, per text, {model: {label: score}}.
Scorer = Callable[[list[str]], list[dict[str, dict[str, float]]]]


_loaded: dict[str, Scorer] = {}


def _worker_scorer(token: str, make_scorer: Callable[[], Scorer]) -> Scorer:
    """The worker's scorer of this call; an earlier call's is let go."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = make_scorer()
    return _loaded[token]


def score_with_lexicon(df: DataFrame, lexicon: DataFrame, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """Default scorer: sentiment shares turned into classifier columns, no Python involved.

    Blank texts get zero toxicity and empty outputs.
    """
    polar = lexicon_polarity(df, lexicon, text, settings)
    scores = fallback_scores(F.col("neg"), F.col("neu"), F.col("pos"))
    blank = is_blank(F.col(text))
    scores["overall_toxicity"] = F.when(blank, F.lit(0.0)).otherwise(scores["overall_toxicity"])
    scores["model_outputs"] = F.when(
        blank, F.struct(*[empty_scores().alias(m) for m in MODELS])).otherwise(scores["model_outputs"])
    return polar.withColumns(scores)


def score_texts(df: DataFrame, make_scorer: Callable[[], Scorer], text: str = "text", batch_size: int = 16) -> DataFrame:
    """Add model_outputs (five label->score maps) and error (null when scored).

    Only the text goes to Python, in Arrow batches, and is scored once. make_scorer runs once per Python
    worker, so a model is loaded once and used for all its tasks. A scorer that returns another number of
    results than it was given texts is an error. Blank texts get empty maps without a model call; a batch
    that fails is retried text by text, so one bad text yields one error row.
    """
    empty = {m: {} for m in MODELS}
    token = uuid.uuid4().hex

    def shaped(result: dict) -> dict:
        return {m: {k: float(v) for k, v in (result.get(m) or {}).items()} for m in MODELS}

    def many(scorer: Scorer, values: list[str]) -> list[tuple[dict | None, dict | None]]:
        try:
            results = scorer(values)
            if len(results) != len(values):
                raise ValueError(f"{len(results)} results for {len(values)} text{'s' if len(values) > 1 else ''}")
            return [(shaped(r), None) for r in results]
        except Exception as e:
            if len(values) == 1:
                return [(None, {"error_type": type(e).__name__, "error_message": str(e)})]
            return [many(scorer, [v])[0] for v in values]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _worker_scorer(token, make_scorer)
        for texts in batches:
            values = texts.fillna("").tolist()
            spoken = [i for i, v in enumerate(values) if v.strip()]
            outcome = [(empty, None)] * len(values)
            for at in range(0, len(spoken), batch_size):
                chunk = spoken[at:at + batch_size]
                for i, r in zip(chunk, many(scorer, [values[i] for i in chunk]), strict=True):
                    outcome[i] = r
            yield pd.DataFrame({"model_outputs": [o for o, _ in outcome], "error": [e for _, e in outcome]}, dtype=object)

    answer = T.StructType([T.StructField("model_outputs", MODEL_OUTPUTS), T.StructField("error", ERROR)])
    # not deterministic as far as the optimiser goes: it may neither repeat a call nor move it below a filter
    score = F.pandas_udf(run, answer).asNondeterministic()
    kept = [c for c in df.columns if c not in ("model_outputs", "error")]
    scored = df.select(*[F.col(f"`{c}`") for c in kept], score(F.col(f"`{text}`")).alias("_answer"))
    return scored.select(*[F.col(f"`{c}`") for c in kept], "_answer.model_outputs", "_answer.error")


def split_errors(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored rows, error rows) of score_texts."""
    failed = F.col("error").isNotNull()
    return scored.filter(~failed).drop("error"), scored.filter(failed).drop("model_outputs")
