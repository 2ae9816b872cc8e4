"""Exact top-k inner-product search over a pivot-distance index.

Vectors are lifted by one coordinate, ``sqrt(M^2 - |x|^2)`` with ``M`` the
largest norm, so that the largest inner product becomes the smallest Euclidean
distance: ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``.  Every vector is keyed by its
nearest pivot and its distance to it; distances are cut into rings (annuli).
A query first evaluates the annuli nearest to it until they hold ``k`` vectors
(its seed), takes the k-th score found as threshold, then expands to every
other annulus whose triangle-inequality bound reaches the threshold and stops
at all the rest.  Only the pivots are fitted on a bounded sample; every vector
is indexed, and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOT_SAMPLE = 2048
CHUNK_ROWS = 4096
QUERY_BLOCK = 4096
MAX_AXIS = 256


def quantize(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``(vec_id, v)`` with ``v = floor(scale * x)``; unusable vectors go.

    Rows with a null id, a null vector, or null or non-finite components take
    no part; a vector without components does.
    """
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), finite.alias("ok"))
        .where(F.col("vec_id").isNotNull() & F.col("ok"))
        .select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))
    )


def _lift(x: np.ndarray, m2: float) -> np.ndarray:
    rest = np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0.0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first centres, then a few rounds of Lloyd's algorithm."""
    picked = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(picked) < min(count, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[picked[-1:]])[:, 0])
    pivots = sample[picked]
    for _ in range(5):
        home = _distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[home == i].mean(0) if (home == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


class _Index:
    """What every task needs: pivots, ring width and the directory of annuli.

    The directory has at most ``MAX_AXIS ** 2`` entries whatever the input.
    """

    def __init__(self, pivots: np.ndarray, m2: float, width: float, rings: int):
        self.pivots, self.m2, self.width, self.rings = pivots, m2, width, rings
        self.cells = np.zeros(0, np.int64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(_lift(x, self.m2), self.pivots)
        home = d.argmin(1)
        dist = d[np.arange(len(x)), home]
        ring = np.minimum((dist / self.width).astype(np.int64), self.rings - 1)
        return home * self.rings + ring, dist

    def directory(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["cell"])
        self.cells = np.array([r["cell"] for r in rows], np.int64)
        self.count = np.array([r["n"] for r in rows], np.int64)
        self.low = np.array([r["low"] for r in rows], float)
        self.high = np.array([r["high"] for r in rows], float)

    def admitted(self, q: np.ndarray, tau: np.ndarray | None, k: int) -> np.ndarray:
        """Boolean (queries, cells): the seed annuli, or those still to expand to."""
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        d = _distances(lifted, self.pivots)[:, self.cells // self.rings]
        gap = np.maximum(np.maximum(d - self.high, self.low - d), 0.0)
        order = np.argsort(gap, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        seed = np.zeros(gap.shape, bool)
        np.put_along_axis(seed, order, before < k + 1, axis=1)
        if tau is None:
            return seed
        slack = 1e-6 * (1.0 + self.m2 + np.einsum("ij,ij->i", q, q))[:, None]
        bound = (np.einsum("ij,ij->i", q, q)[:, None] + self.m2 - gap**2) / 2 + slack
        return ~seed & (bound >= tau[:, None])


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; float64 holds them below 2**53."""
    qi, xi = q.astype(np.int64), x.astype(np.int64)
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return qi @ xi.T


def topk(vectors: DataFrame, queries: DataFrame, k: int = 20, chunk_rows: int = CHUNK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest products.

    ``vectors`` has ``(vec_id, v)``, ``queries`` ``(query_id, v)``, both from
    :func:`quantize`.  A query's own id is no candidate and equal scores go to
    the smaller ``vec_id``.  Every row is a candidate, so equal rows count as
    often as they occur; equal queries are asked once.  Vectors shorter than
    the longest are read as filled up with zeros.  Fewer than ``k`` candidates
    give fewer rows; empty tables give none; other columns are left out.
    """
    spark = vectors.sparkSession
    stats = vectors.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)).alias("m2")).first()
    asked_dim = queries.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if not stats["n"] or asked_dim[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, m2, dim = stats["n"], float(stats["m2"]), max(1, stats["dim"], asked_dim[1])
    if min(stats["short"], asked_dim[0]) < dim:
        filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")
        vectors, queries = vectors.select("vec_id", filled), queries.select("query_id", filled)
    queries = queries.select("query_id", "v").dropDuplicates()

    sample = np.array([r["v"] for r in vectors.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(PIVOT_SAMPLE).collect()], float)
    lifted = _lift(sample, m2)
    n_pivots = int(min(MAX_AXIS, max(2, round((n / chunk_rows) ** 0.5))))
    rings = int(min(MAX_AXIS, max(2, -(-n // (chunk_rows * n_pivots)))))
    pivots = _fit_pivots(lifted, n_pivots)
    widest = float(_distances(lifted, pivots).min(1).max())
    index = _Index(pivots, m2, max(widest, 1e-9) / rings, rings)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, dist = index.place(_matrix(b["v"]))
                yield b.assign(cell=cell, dist=dist)

    placed = vectors.select("vec_id", "v").mapInPandas(place, "vec_id long, v array<long>, cell long, dist double")
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "topk-index")
    index.directory(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect())
    chunks = -(-index.count // chunk_rows)

    def admitted(b: pd.DataFrame, seeded: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for start in range(0, len(b), 512):
            part = b.iloc[start : start + 512]
            yield part, index.admitted(_matrix(part["v"]), part["tau"].to_numpy(float) if seeded else None, k)

    def tally(batches: Iterator[pd.DataFrame], seeded: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, keep in admitted(b, seeded):
                n_of = keep.sum(0)
                yield pd.DataFrame({"cell": index.cells[n_of > 0], "n": n_of[n_of > 0].astype(np.int64)})

    def expand(batches: Iterator[pd.DataFrame], seeded: bool, blocks: np.ndarray) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, keep in admitted(b, seeded):
                ids = part["query_id"].to_numpy(np.int64)
                qi, ci = np.nonzero(keep)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = (mixed[qi] % blocks[ci].astype(np.uint64)).astype(np.int64)
                times = chunks[ci]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                qi, ci, block = np.repeat(qi, times), np.repeat(ci, times), np.repeat(block, times)
                yield pd.DataFrame({"query_id": ids[qi], "q": part["v"].to_numpy()[qi], "tau": part["tau"].to_numpy(float)[qi], "cell": index.cells[ci], "chunk": chunk.astype(np.int64), "block": block})

    def evaluate(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            x = _matrix(left["v"])
            ids = left["vec_id"].to_numpy()
            for start in range(0, len(right), 512):
                part = right.iloc[start : start + 512]
                s = _products(_matrix(part["q"]), x)
                own, tau = part["query_id"].to_numpy(), part["tau"].to_numpy(float)
                for i in range(len(part)):
                    ok = np.flatnonzero((ids != own[i]) & (s[i] >= tau[i]))
                    if len(ok) > k:
                        kth = np.partition(s[i][ok], len(ok) - k)[len(ok) - k]
                        ok = ok[s[i][ok] >= kth]
                    ok = ok[np.lexsort((ids[ok], -s[i][ok]))[:k]]
                    if len(ok):
                        out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[ok], "score": s[i][ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    def found(asked: DataFrame, seeded: bool) -> DataFrame:
        """A cell's vectors meet its queries, both in parts of bounded size: only cells that are asked travel, once for each block of queries."""
        tallied = {r["cell"]: r["n"] for r in asked.mapInPandas(lambda b: tally(b, seeded), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # one row a cell
        blocks = np.array([-(-tallied.get(int(c), 0) // query_block) for c in index.cells], np.int64)
        parts = [(int(c), int(m), int(q)) for c, m, q in zip(index.cells, chunks, blocks) if q]
        table = F.broadcast(spark.createDataFrame(parts, "cell long, chunks long, blocks long"))  # one row a cell
        store = placed.join(table, "cell").select("vec_id", "v", "cell", F.pmod(F.xxhash64("row"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        plan = asked.mapInPandas(lambda b: expand(b, seeded, blocks), "query_id long, q array<long>, tau double, cell long, chunk long, block long")
        keys = ["cell", "chunk", "block"]
        return store.groupBy(*keys).cogroup(plan.groupBy(*keys)).applyInPandas(evaluate, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    low = F.lit(float("-inf"))
    seed = materialize(found(queries.select("query_id", "v", low.alias("tau")), False), "topk-seed")
    ranked = seed.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("tau"))
    asked = queries.select("query_id", "v").join(ranked, "query_id", "left").select("query_id", "v", F.coalesce("tau", low).alias("tau"))
    every = seed.unionByName(found(asked, True))  # no cell is expanded to twice
    return every.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
