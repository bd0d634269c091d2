"""Embedding near-duplicates: coarse inverted lists, product-quantised residuals, exact rerank.

Unit vectors are listed under their nearest coarse centroid; what remains is coded per subspace. A
query probes every list whose centroid is not much farther (in angle) than its nearest one. In a
list, table look-ups give approximate cosines; the stored length of each vector's coding error
bounds how far they can be off, so no pair at the threshold is lost there. What is left gets its
exact cosine in double precision.

Centroids and codebooks are fitted on a bounded sample; every vector is listed and every vector is a
query. Lists are cut into blocks of bounded size; tasks return counts per vector and a spanning
forest of their links, never the pairs.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing and are their own component. Every row is a vector of its own, rows with
an equal id or without one too; a component is called by its smallest id, null if it has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import stored
from .components import components
from .jaccard import forest

COSINE = 0.95
#: Vectors on which centroids and codebooks are fitted.
SAMPLE = 16_384
#: Coarse centroids: one for so many vectors, at most so many.
LIST_SIZE = 128
CENTROIDS = 1_024
SUBSPACES = 8
CODES = 64
#: Lists are probed whose angle to the query exceeds the nearest one's by this share of the link angle at most.
PROBE = 1 / 3
#: Vectors of a block, queries or listed ones.
BLOCK = 1_024


@dataclass
class Quantiser:
    centroids: np.ndarray
    books: np.ndarray
    probe_angle: float

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.centroids.T / np.linalg.norm(self.centroids, axis=1), -1, 1))

    def encode(self, residual: np.ndarray) -> np.ndarray:
        """Nearest code in each subspace."""
        out = np.empty((len(residual), len(self.books)), np.uint8)
        for s, book in enumerate(self.books):
            part = residual[:, s * book.shape[1]:(s + 1) * book.shape[1]]
            out[:, s] = ((book ** 2).sum(1) - 2 * part @ book.T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def fit(sample: np.ndarray, cosine: float, centroids: int = CENTROIDS, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    d = sample.shape[1]
    subspaces = next(s for s in range(min(subspaces, d), 0, -1) if d % s == 0)
    coarse = k_means(sample, centroids)
    coarse = coarse[np.linalg.norm(coarse, axis=1) > 1e-9]
    near = ((coarse ** 2).sum(1) - 2 * sample @ coarse.T).argmin(1)
    rest = sample - coarse[near]
    width = d // subspaces
    books = [k_means(rest[:, s * width:(s + 1) * width], codes) for s in range(subspaces)]
    return Quantiser(coarse, np.stack(books), PROBE * float(np.arccos(cosine)))


def unit_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and their row numbers."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False))
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    most = np.abs(x).max(1, initial=0.0)  # null components are NaN here
    fine = np.isfinite(x).all(1) & (most > 0)
    x, rows = x[fine] / most[fine, None], rows[fine]
    return x / np.sqrt((x * x).sum(1, keepdims=True)), rows


def _assign(q: Quantiser, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x, rows = unit_rows(part.column(1), width)
                if not len(rows):
                    continue
                angle = q.angles(x)
                home = angle.argmin(1)
                probes = angle <= angle.min(1, keepdims=True) + q.probe_angle
                codes = q.encode(x - q.centroids[home])
                near = q.centroids[home] + q.decode(codes)
                error = np.linalg.norm(x - near, axis=1)
                at, probed = np.nonzero(probes)
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(rows)))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "row": part.column(0).take(pa.array(rows)),
                    "unit": pa.array([r.tobytes() for r in x], pa.binary()),
                    "home": pa.array(home, pa.int32()),
                    "probes": pa.ListArray.from_arrays(pa.array(ends), pa.array(probed, pa.int32())),
                    "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                    "error": pa.array(error, pa.float64())})
    return run


def _search(q: Quantiser, cosine: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """One block of a list against one block of the queries that probe it."""
        here = table.column("list")[0].as_py()
        listed = table.column("listed").to_numpy(zero_copy_only=False)
        ids = table.column("row").to_numpy()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        home = table.column("home").to_numpy()
        probes = table.column("probes").combine_chunks()
        # (row, list) of every probe, as one number
        probed = np.repeat(np.arange(len(ids)), pc.list_value_length(probes).to_numpy()) * CENTROIDS + probes.flatten().to_numpy()
        base, query = np.flatnonzero(listed), np.flatnonzero(~listed)
        n = np.zeros(len(ids), np.int64)
        pairs = np.zeros((0, 2), np.int64)
        if len(base) and len(query):
            codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(base)).to_pylist()), np.uint8).reshape(len(base), -1)
            error = table.column("error").to_numpy()[base]
            # distance tables: each query against every code of each subspace, and the coarse centroid
            width = q.books.shape[2]
            near = np.repeat((x[query] @ q.centroids[here])[:, None], len(base), 1)
            for s, book in enumerate(q.books):
                near += (x[query][:, s * width:(s + 1) * width] @ book.T)[:, codes[:, s]]
            # the rest of a vector is no longer than its coding error, and a query has length 1
            i, j = np.nonzero(near >= cosine - error[None, :] - 1e-9)
            exact = np.einsum("ij,ij->i", x[query[i]], x[base[j]])
            ok = (exact >= cosine) & (ids[query[i]] != ids[base[j]])
            i, j = query[i[ok]], base[j[ok]]
            # a pair within the list is met from both sides; others count for the listed one only if it
            # will not look into the query's list itself
            blind = (home[i] != here) & ~np.isin(j * CENTROIDS + home[i], probed)
            np.add.at(n, i, 1)
            np.add.at(n, j[blind], 1)
            pairs = np.stack([i, j], 1)
        label = forest(len(ids), pairs)
        tied = np.flatnonzero(label != np.arange(len(ids)))
        some = np.flatnonzero(n)
        return pa.table({
            "u": pa.array(np.concatenate([ids[label[tied]], ids[some]]), pa.int64()),
            "v": pa.array(np.concatenate([ids[tied], np.full(len(some), -1)]), pa.int64()),
            "n": pa.array(np.concatenate([np.zeros(len(tied), np.int64), n[some]]), pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", column: str = "embedding",
                    sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`."""
    rows = stored(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("vec_id"),
        F.col(f"`{column}`").cast("array<double>").alias("x")), "vectors")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.col("vec_id").isNotNull().alias("kept"))
    usable = rows.filter("x IS NOT NULL")
    common = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or common["d"] < 1:
        return alone
    width = common["d"]
    # the fitting sample: the rows with the smallest hash of the id, at most `sample`
    drawn = usable.filter(F.size("x") == width).orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id", "row").limit(sample)
    fitted, _ = unit_rows(drawn.select("x").toArrow().column(0).combine_chunks(), width)
    if not len(fitted):
        return alone
    q = fit(fitted, cosine, min(CENTROIDS, max(16, common["count"] // LIST_SIZE)))
    placed = stored(usable.select("row", "x").mapInArrow(
        _assign(q, width), "row long, unit binary, home int, probes array<int>, codes binary, error double"), "placed")
    sizes = placed.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("held"))
    probing = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("asked"))
    blocks = {r["list"]: (-(-r["held"] // BLOCK), -(-r["asked"] // BLOCK))
              for r in sizes.join(probing, "list").collect()}  # CENTROIDS rows
    held = F.create_map(*[F.lit(v) for k, (h, _) in blocks.items() for v in (k, h)])
    asked = F.create_map(*[F.lit(v) for k, (_, a) in blocks.items() for v in (k, a)])
    draw = F.xxhash64("row")
    listed = (placed.withColumn("list", F.col("home")).withColumn("listed", F.lit(True))
              .withColumn("block", F.pmod(draw, held[F.col("list")]).cast("int"))
              .withColumn("turn", F.explode(F.sequence(F.lit(0), asked[F.col("list")].cast("int") - 1))))
    queries = (placed.withColumn("list", F.explode("probes")).filter(F.col("list").isin(list(blocks)))
               .withColumn("listed", F.lit(False))
               .withColumn("turn", F.pmod(draw, asked[F.col("list")]).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), held[F.col("list")].cast("int") - 1))))
    columns = ["list", "block", "turn", "listed", "row", "unit", "home", "probes", "codes", "error"]
    met = listed.select(*columns).unionByName(queries.select(*columns))
    found = stored(met.groupBy("list", "block", "turn").applyInArrow(_search(q, cosine), "u long, v long, n long"), "found")
    counts = found.filter("v = -1").groupBy(F.col("u").alias("row")).agg(F.sum("n").alias("n_links"))
    tied = components(found.filter("v <> -1").select("u", "v"))
    about = stored(rows.select("row", "vec_id").join(counts, "row", "left").join(
        tied.withColumnRenamed("node", "row"), "row", "left"), "about")
    # components go by rows; they are called by their smallest id
    names = about.filter("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("name"))
    return (about.join(names, "component", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("name", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
