"""A Merkle manifest of a table: leaf hashes, one tree of arity 3 per group, one tree over the groups.

Nodes lie on rows in the order of their tree. At level k the node of a run stands on its first leaf's
row, so the other nodes of its run are found by lag and lead of 3**k and 2 * 3**k rows, masked by the
node's slot; a short last run has no row there. First children hash the parents and carry them on.

Windows span 3**LEVELS rows of a group, aligned, so that no run crosses them and no group is ordered in
one task; the tops of the windows are the rows of the next round. A path comes down by joins on (group,
window), never on the group alone, so a group that holds a third of all rows is spread like any other.

Defined cases: rows of equal key are ordered by their leaf, so the roots do not depend on the order of
input; equal rows are separate leaves. A null group is a group of its own and the first; a null key is
the first of its group and never tampered with. An empty table has no rows here and no root. Texts are
hashed whole. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stored
from .positions import positions

ARITY = 3
#: Levels of a tree within one window.
LEVELS = 5
SPAN = ARITY ** LEVELS
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other; null counts as nothing."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its byte count, a colon and itself; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def _climb(nodes: DataFrame) -> DataFrame:
    """Adds block, the path within the window, and `top` on the window's first row."""
    w = Window.partitionBy("key", "block").orderBy("pos")
    out = nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).withColumn("_h0", F.col("h"))
    for k in range(LEVELS):
        reach = ARITY ** k
        h = f"_h{k}"
        out = out.withColumns({
            f"_{side}{k}_{d}": f(h, d * reach).over(w) for side, f in (("lag", F.lag), ("lead", F.lead)) for d in (1, 2)})
        starts, more = F.col("pos") % reach == 0, F.col("n") > reach
        parent = F.when(more, digest(F.col(h), F.col(f"_lead{k}_1"), F.col(f"_lead{k}_2"))).otherwise(F.col(h))
        slot = F.floor(F.col("pos") / reach) % ARITY

        def joined(*names: str) -> Column:
            return F.concat(*[F.coalesce(F.col(x), F.lit("")) for x in names])

        left = (F.when(slot == 1, F.col(f"_lag{k}_1"))
                .when(slot == 2, joined(f"_lag{k}_2", f"_lag{k}_1")).otherwise(F.lit("")))
        right = (F.when(slot == 0, joined(f"_lead{k}_1", f"_lead{k}_2"))
                 .when(slot == 1, joined(f"_lead{k}_1")).otherwise(F.lit("")))
        out = out.withColumns({
            f"_step{k}": F.when(starts & more, F.struct(left.alias("left"), right.alias("right"))),
            f"_h{k + 1}": F.when(F.col("pos") % (reach * ARITY) == 0, parent)})
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a node's step, on all rows below it
    steps = [F.last(f"_step{k}", ignorenulls=True).over(run) for k in range(LEVELS)]
    return out.select(
        *nodes.columns, "block", F.col(f"_h{LEVELS}").alias("top"),
        F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(PATH).alias("path"))


def _paths(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds to (key, pos, n, h) the path to the root and what `above` gives each key's root (key, h)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return above(nodes)
    level = _climb(nodes)
    tops = stored(level.filter(F.col("pos") % SPAN == 0).select(
        "key", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("h")), "tops")
    upper = _paths(tops, above)
    added = [c for c in upper.columns if c not in ("key", "pos", "n", "h", "path")]
    upper = upper.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *added)
    return (level.join(upper, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_pos")))
            .select(*nodes.columns, F.concat("path", "_path").alias("path"), *added))


def _root(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"path": F.array().cast(PATH), "root": F.col("h")})


def _roots(nodes: DataFrame) -> DataFrame:
    """One row per key with its root h: adds subroot, and the path and root of the tree over all keys."""
    each = positions(nodes.select(F.lit(0).alias("key"), F.col("key").alias("group"), "h"), "key", [F.col("group")], "subroots")
    top = _paths(stored(each, "groups"), _root).select(F.col("group").alias("_key"), "path", "root")
    return nodes.withColumn("subroot", F.col("h")).join(top, F.col("key") == F.col("_key")).drop("_key")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(rows: DataFrame, group: str, key: str, fields: Sequence[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    `fields` are hashed into the leaf. `tampered` replaces fields by other values for the leaf from which
    folded_root is computed, with the siblings of the untouched table.
    """
    taken = {f: F.col(f"`{f}`") for f in fields}
    name = F.col(f"`{group}`")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("")).alias("key"), F.col(f"`{key}`").alias("id"),
        leaf(list(taken.values())).alias("h"), leaf(list((taken | (tampered or {})).values())).alias("given"),
    ).withColumn("given", F.when(F.col("given") != F.col("h"), F.col("given")))
    nodes = stored(positions(stored(leaves, "leaves"), "key", [F.col("id"), F.col("h")], "ordered"), "nodes")
    proven = _paths(nodes, _roots)
    return proven.select(
        F.col("id").alias(key), F.col("h").alias("leaf"), "subroot", "root",
        digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")).alias("proof_sha256"),
        fold(F.coalesce("given", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
