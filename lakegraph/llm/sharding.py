"""Hilbert-curve sharding with DataFrame functions only.

Several metadata columns are quantised to a few bits each, rows are sorted by their place on a Hilbert curve through the
resulting grid, and the sorted sequence is cut into runs of equal row counts. Neighbours on the curve are neighbours in
every dimension, so each run covers a small box and file statistics prune on any of the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import positions, set_aside, unsigned_bytes

BITS = 5
SHARDS = 8
#: Steps of the size dimension for each doubling of a size.
SIZE_STEPS_PER_OCTAVE = 1.5


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each (orientation, cell of the 2^dims half-size cells): its rank along the curve, and the orientation inside it.

    An orientation is the corner ``e`` where the curve enters and the axis ``d`` of its first step.
    """
    size = 1 << dims

    def rotate(x: int, k: int) -> int:
        k %= dims
        return ((x >> k) | (x << (dims - k))) & (size - 1)

    gray = [i ^ (i >> 1) for i in range(size)]
    rank_of = {g: i for i, g in enumerate(gray)}
    ranks, following = [], []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for cell in range(size):
            w = rank_of[rotate(cell ^ e, d + 1)]
            entry = 0 if w == 0 else gray[2 * ((w - 1) // 2)]
            turn = w if w % 2 else w - 1
            axis = 0 if w == 0 else ((turn ^ (turn + 1)).bit_length() - 1) % dims
            ranks.append(w)
            following.append((e ^ rotate(entry, -(d + 1))) * dims + (d + axis + 1) % dims)
    return ranks, following


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Place on the curve of the cell with the given coordinates (each ``0 .. 2^bits - 1``), as a long."""
    dims = len(codes)
    ranks, following = (F.array(*map(F.lit, t)) for t in curve_tables(dims))

    def step(acc: Column, level: Column) -> Column:
        cell = sum((F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(codes)), F.lit(0))
        at = acc["s"] * (1 << dims) + cell + 1
        return F.struct(F.element_at(following, at).cast("int").alias("s"), (acc["h"] * (1 << dims) + F.element_at(ranks, at)).cast("long").alias("h"))

    start = F.struct(F.lit(0).cast("int").alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def text_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """At most ``2^bits - 1`` values that split the sorted distinct values of a column evenly; only the cuts reach the driver."""
    most = (1 << bits) - 1
    values = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    few = [r.v for r in values.limit(most + 1).collect()]
    if len(few) <= most:
        return sorted(few, key=lambda s: s.encode())
    placed = positions(values, ["v"], "cuts")
    n = placed.count()
    step = -(-n // most)
    return [r.v for r in placed.where(F.col("_pos") % step == 0).orderBy("v").collect()]


def text_code(value: Column, cuts: list[str]) -> Column:
    """0 for null, else the number of cuts at or before the value (at least 1)."""
    if not cuts:
        return F.lit(0)
    value = value.cast("string")
    before = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.greatest(before, F.lit(1))).cast("int")


def size_code(size: Column, bits: int) -> Column:
    """Logarithmic scale; 0 for null or sizes below 1."""
    return F.coalesce(F.when(size >= 1, F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size.cast("double")) * SIZE_STEPS_PER_OCTAVE))), F.lit(0)).cast("int")


def hilbert_shards(df: DataFrame, text_dims: list[str], size_dim: Column, ties: list[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Adds ``_curve`` (place on the curve), ``_shard`` (0 to shards - 1) and ``_slot`` (0, 1, ... within the shard).

    Law: row counts of any two shards differ by at most one. All rows stay, repeated ones included. Nulls have their
    own cell; an empty table stays empty. ``ties`` order rows of one cell: give columns that tell rows apart, so that a
    cell with most of the rows is still cut and spread. Names that begin with ``_`` are the operator's.
    """
    codes = [text_code(F.col(c), text_cuts(df, c, bits)) for c in text_dims] + [size_code(size_dim, bits)]
    coded = df.select("*", *(c.alias(f"_code{k}") for k, c in enumerate(codes)))
    curve = coded.withColumn("_curve", hilbert_index([F.col(f"_code{k}") for k in range(len(codes))], bits)).drop(*(f"_code{k}" for k in range(len(codes))))
    placed = positions(curve, [F.col("_curve"), *ties], "curve")
    n = max(1, placed.count())
    shard = F.expr(f"_pos * {shards} div {n}")
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard.cast("int")).withColumn("_slot", F.col("_pos") - first).drop("_pos")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard, rows in curve order, so that row-group statistics bound every dimension."""
    sharded.repartitionByRange(F.col("_shard"), F.col("_slot")).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The query's digest: a row for each document with its size, CRC, law, shard and slot. Texts are not shuffled."""
    narrow = docs.select("doc_id", (unsigned_bytes(F.col("text")) + 1).alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    placed = hilbert_shards(narrow, ["source", "lang"], F.col("size"), [F.col("doc_id"), F.col("text_crc32")], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Whole documents with ``shard``, ``slot`` and ``curve``. A column that already has such a name goes on under it and ``_given``.

    Nulls in any column and empty texts have their place on the curve; ties stand by id and hash of the text, repeated rows
    all stay; an empty table stays empty.
    """
    given = set_aside(docs, "shard, slot, curve")
    packed = docs.select(F.struct("*").alias("_doc"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), unsigned_bytes(F.col("text")).alias("_size"))
    placed = hilbert_shards(packed, ["_source", "_lang"], F.col("_size"), [F.col("_id"), F.col("_text_hash")], shards)
    kept = [F.col(f"_doc.`{c}`").alias(new) for c, new in zip(docs.columns, given.columns, strict=True)]
    return placed.select(*kept, F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.col("_curve").alias("curve"))
