"""The nearest vectors of many queries: an exact search by blocks, and an inverted file of cells that looks at a few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.sources.sinks import stored as written

#: Vectors and queries that meet in one task.
BLOCK = 4096
#: Vectors that the cells' centres are fitted on: those of the least hashes.
SAMPLE = 20_000
FOUND = "query_id long, id long, similarity double"


def clamped(k: int, most: int = 50) -> int:
    """A page of neighbours has 1 to ``most``."""
    return max(1, min(most, k))


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length; a vector without length stays zero, so that it is like none. All must have one dimension."""
    rows = [v.values for v in vectors]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of different dimensions")
    m = np.array([r.to_numpy(zero_copy_only=False) for r in rows], np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300) if len(m) else m


def _nearest(k: int):
    """For a group's vectors and queries: each query's ``k`` most similar vectors, ties by id."""

    def of_group(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "similarity": []}
        if vectors.num_rows and queries.num_rows:
            ids, asked = (t.column("_id").to_numpy() for t in (vectors, queries))
            order = np.argsort(ids, kind="stable")
            ids, likeness = ids[order], matrix(queries.column("_v")) @ matrix(vectors.column("_v"))[order].T
            for q, row in zip(asked.tolist(), np.round(likeness, 12), strict=True):
                best = np.argsort(-row, kind="stable")[:k]
                out["query_id"] += [q] * len(best)
                out["id"] += ids[best].tolist()
                out["similarity"] += row[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "similarity": pa.array(out["similarity"], pa.float64())})

    return of_group


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"))


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, similarity, rank``: each query's ``k`` vectors of greatest cosine, by comparing all in blocks.

    Both sides have ``id, embedding``. Blocks of vectors meet blocks of queries, and each meeting hands on ``k`` rows a
    query, so that no pair leaves its task. Null vectors are left out; a query finds itself if it is among the vectors.
    """
    k = clamped(k)
    v, q = (df.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("_id"), F.col("embedding").alias("_v")) for df in (vectors, queries))
    nv, nq = (max(1, -(-df.count() // BLOCK)) for df in (v, q))
    v = _blocks(v, nv, "_a").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = _blocks(q, nq, "_b").withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    found = v.groupBy("_a", "_b").cogroup(q.groupBy("_a", "_b")).applyInArrow(_nearest(k), FOUND)
    return _top(found, k)


def centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors; a cell that loses all its vectors takes the one that is least like its centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        likeness = sample @ c.T
        of = likeness.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(likeness.max(1))[: len(empty)]]
        c = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-300)
    return c


def _in_cells(df: DataFrame, c: np.ndarray, probes: int) -> DataFrame:
    """``_id, _v, _cell, _near``: each vector in its ``probes`` nearest cells, the nearest is 0."""
    shared = df.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.argsort(-(matrix(batch.column("_v")) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1])))
                near = np.tile(np.arange(cells.shape[1], dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.ravel().astype(np.int32)), pa.array(near)], names=["_id", "_v", "_cell", "_near"])

    return df.select("_id", "_v").mapInArrow(run, "_id long, _v array<float>, _cell int, _near int")


class CellIndex:
    """Vectors dealt out by the nearest of ``cells`` centres and written once; a search looks at the nearest ``probes`` cells.

    Every vector is in the index. Only the centres are fitted on a bounded sample; they are the only thing that is sent to
    all tasks (``cells`` rows). A cell of any size is cut into parts of about ``BLOCK``.
    """

    def __init__(self, vectors: DataFrame, cells: int = 64, sample: int = SAMPLE):
        v = vectors.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("_id"), F.col("embedding").cast("array<float>").alias("_v"))
        few = v.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").toArrow()
        self.centres = centres(matrix(few.column("_v")), cells) if few.num_rows else np.zeros((0, 1))
        placed = written(_in_cells(v, self.centres, 1).drop("_near"), "cells")
        self.sizes = placed.groupBy("_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts"))  # a row for each cell
        self.placed = placed.join(self.sizes, "_cell").withColumn("_a", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts")

    def probes_for(self, queries: DataFrame, exact: DataFrame, target: float = 0.95) -> int:
        """The number of cells at which a share of ``target`` of the exact neighbours (of ``exact_nearest``) is found."""
        q = queries.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("_id"), F.col("embedding").cast("array<float>").alias("_v"))
        ranks = _in_cells(q, self.centres, len(self.centres)).select(F.col("_id").alias("query_id"), "_cell", "_near")
        at = exact.select("query_id", F.col("id").alias("_id")).join(self.placed.select("_id", "_cell"), "_id").join(ranks, ["query_id", "_cell"])
        found = at.agg(F.percentile("_near", F.lit(target)).alias("n")).head()["n"]
        return 1 if found is None else int(np.ceil(found)) + 1

    def nearest(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """``query_id, id, similarity, rank``, as ``exact_nearest`` but for vectors in cells that are not looked at."""
        k = clamped(k)
        q = queries.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("_id"), F.col("embedding").cast("array<float>").alias("_v"))
        q = _in_cells(q, self.centres, probes).drop("_near").join(self.sizes, "_cell")
        asked = written(q, "cell-queries")
        many = asked.groupBy("_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_many"))
        asked = asked.join(many, "_cell").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_many")).cast("int"))
        asked = asked.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("_cell", "_a", "_b", "_id", "_v")
        placed = self.placed.join(many, "_cell").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_many") - 1))).select("_cell", "_a", "_b", "_id", "_v")
        keys = ["_cell", "_a", "_b"]
        return _top(placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_nearest(k), FOUND), k)


def recall(found: DataFrame, exact: DataFrame) -> Column:
    """Share of the exact neighbours that were found, as a one-row frame."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("_hit") / F.greatest(F.lit(1), F.count("*"))).alias("recall"))
