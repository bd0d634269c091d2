"""Sentiment shares of a text from a valence lexicon."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEFAULTS, Settings
from ..sources.scratch import stored

#: Words are runs of letters of any script.
TOKEN_BREAK = r"[^\p{L}]+"

# Fixed value: the normaliser of the compound score (Hutto & Gilbert 2014).
COMPOUND_NORM = 15.0
#: Rows are looked up in blocks of 2 to this power.
BLOCK_BITS = 11


def pieces(text: Column) -> Column:
    """Lower-case tokens; the first and last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK)


def token_count(parts: str) -> Column:
    first, last = F.element_at(parts, 1) == "", F.element_at(parts, -1) == ""
    return (F.size(parts) - first.cast("int") - (last & (F.size(parts) > 1)).cast("int")).cast("double")


def _shares(df: DataFrame, gain: Column, loss: Column, rest: Column, total_valence: Column) -> DataFrame:
    """neg/neu/pos shares and compound from the four sums."""
    return (
        df.withColumns({"_pos": gain, "_neg": loss, "_neu": rest, "_val": total_valence})
        .withColumn("_all", F.col("_pos") + F.col("_neg") + F.col("_neu"))
        .withColumns({
            name: F.when(F.col("_all") > 0, F.col(f"_{name}") / F.col("_all")).otherwise(F.lit(0.0))
            for name in ("neg", "neu", "pos")})
        .withColumn("compound", F.col("_val") / F.sqrt(F.col("_val") * F.col("_val") + COMPOUND_NORM))
        .drop("_pos", "_neg", "_neu", "_val", "_all")
    )


def _add(values: Column, part) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + part(v))


def lexicon_polarity(df: DataFrame, lexicon: DataFrame, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """Add neg, neu, pos and compound to each row.

    Terms or valences that are null don't count; of several valences of a term the one farthest from 0
    does, the negative one of two equally far. A lexicon of at most `max_inline_lexicon` terms becomes a
    literal and the whole step is a projection. A larger one is joined to the distinct words of blocks of numbered
    rows, with the same result: every row has its own, whatever its keys.
    """
    limit = settings.max_inline_lexicon
    lexicon = one_valence(lexicon)
    head = lexicon.limit(limit + 1).collect()
    if len(head) > limit:
        return _joined(df, lexicon, text)
    valence = {r["term"]: r["valence"] for r in head}
    if not valence:
        zero = F.lit(0.0)
        return _shares(df.withColumn("_parts", pieces(F.col(text))), zero, zero, token_count("_parts"), zero).drop("_parts")
    terms = list(valence)
    lookup = F.create_map(*[F.lit(x) for pair in valence.items() for x in pair])
    df = (
        df.withColumn("_parts", pieces(F.col(text)))
        .withColumn("_hits", F.transform(F.filter("_parts", lambda w: w.isin(terms)), lambda w: lookup[w]))
    )
    hits = F.col("_hits")
    signed = F.size(F.filter(hits, lambda v: v != 0))
    return _shares(
        df,
        _add(hits, lambda v: F.when(v > 0, v + 1).otherwise(F.lit(0.0))),
        _add(hits, lambda v: F.when(v < 0, 1 - v).otherwise(F.lit(0.0))),
        token_count("_parts") - signed,
        _add(hits, lambda v: v),
    ).drop("_parts", "_hits")


def one_valence(lexicon: DataFrame) -> DataFrame:
    """(term, valence) with each term once."""
    v = F.col("valence")
    return (lexicon.select("term", v.cast("double")).filter(F.col("term").isNotNull() & v.isNotNull())
            .groupBy("term").agg(F.max_by("valence", F.struct(F.abs("valence"), -v)).alias("valence")))


def _joined(df: DataFrame, lexicon: DataFrame, text: str) -> DataFrame:
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "numbered", "zstd")
    words = F.filter(pieces(F.col(text)), lambda w: w != "")
    blocked = df.select(F.shiftright("_row", BLOCK_BITS).alias("_block"), "_row", words.alias("_words"))
    # of a block every word is looked up once, however often its rows have it; words of letters hold no space
    known = blocked.select(F.col("_block").alias("_of"), F.explode("_words").alias("term")).distinct().join(lexicon, "term")
    rows = blocked.select("_block", "_row", F.array_join("_words", " ").alias("_words"))
    sums = rows.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(
        _block_sums, "_row bigint, _gain double, _loss double, _rest double, _sum double")
    joined = df.join(sums, "_row", "left").fillna(0.0, ["_gain", "_loss", "_rest", "_sum"])
    return _shares(joined, F.col("_gain"), F.col("_loss"), F.col("_rest"), F.col("_sum")).drop(
        "_row", "_gain", "_loss", "_rest", "_sum")


def _block_sums(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The four sums of each row of a block from the valences of the block's words."""
    terms, valences = known.column("term").combine_chunks(), known.column("valence").to_numpy()
    parts = []
    for batch in rows.select(["_row", "_words"]).to_batches(max_chunksize=256):
        words = pc.split_pattern(batch.column("_words"), " ")
        row, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a row without words has one empty piece
        spot = pc.fill_null(pc.index_in(flat, value_set=terms), len(terms)).to_numpy(zero_copy_only=False)
        v = np.append(valences, 0.0)[spot]
        up = ~(v <= 0)  # as in Spark, where NaN is above every number

        def total(value: np.ndarray, row: np.ndarray = row, n: int = batch.num_rows) -> pa.Array:
            return pa.array(np.bincount(row, value, n).astype(float))

        parts.append(pa.table({
            "_row": batch.column("_row"), "_gain": total(np.where(up, v + 1, 0.0)), "_loss": total(np.where(v < 0, 1 - v, 0.0)),
            "_rest": total(np.where(real & (v == 0), 1.0, 0.0)), "_sum": total(v)}))
    empty = {c: pa.array([], pa.float64()) for c in ("_gain", "_loss", "_rest", "_sum")}
    return pa.concat_tables(parts) if parts else pa.table({"_row": pa.array([], pa.int64()), **empty})
