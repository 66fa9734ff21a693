"""Helpers that several operators share: written scratch tables, global positions and batched text mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_SCRATCH.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-llm-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends there and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths written since the outermost scratch() that are to be removed at its end.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes what was ``written`` inside at the end; nothing lazy that reads it may leave the block."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        remove(spark, _OPEN.pop())


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def positions(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``_pos``, each row's 0-based place in the total order, without ever gathering rows in one task.

    Rows are range-partitioned, sorted and numbered inside their partition and written once; a partition's first
    place is a running sum over the row counts of the partitions (as many rows as shuffle partitions). Rows that tie in
    all order columns are interchangeable, so end ``order`` with columns that tell the others apart.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_pos", at).drop("_part", "_start", "_mid")


def set_aside(df: DataFrame, names: str) -> DataFrame:
    """Renames a caller's columns that have one of an operator's ``names`` (a schema or a list, any case) to ``<name>_given``."""
    taken = {x.split()[0].lower() for x in names.split(",")}
    have = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in taken:
            new = f"{c}_given"
            while new.lower() in have:
                new += "_given"
            have.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def utf8_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return col.cast(pa.large_binary()).to_pylist()


#: Rows that a text function gets at once; bounds its memory where texts are long.
SLICE = 256


def map_texts(df: DataFrame, text: str, schema: str, fn: Callable[..., dict[str, list]], also: Sequence[str] = ()) -> DataFrame:
    """Replaces column ``text`` by the columns of ``schema``, which ``fn`` makes from a batch of UTF-8 texts (bytes or None).

    Columns named in ``also`` are given to ``fn`` as further lists and are replaced as well; the others pass through.
    """
    kept = [c for c in df.columns if c != text and c not in also]
    made = StructType.fromDDL(schema)
    out = StructType([*(df.schema[c] for c in kept), *made])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                column = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols = fn(utf8_bytes(column[text]), *(column[c].to_pylist() for c in also))
                arrays = [column[c].cast(arrow.field(c).type) for c in kept] + [pa.array(cols[f.name], arrow.field(f.name).type) for f in made]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def text_udf(schema: str, fn: Callable[[list[bytes | None]], dict[str, list]]) -> Callable[[Column], Column]:
    """A column function from texts to a struct of ``schema``; only the text goes to Python, other columns stay in the JVM."""
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    @F.arrow_udf(made)
    def run(texts: pa.Array) -> pa.Array:
        parts = [fn(utf8_bytes(texts.slice(at, SLICE))) for at in range(0, len(texts), SLICE)] or [fn([])]
        return pa.StructArray.from_arrays([pa.array([x for p in parts for x in p[f.name]], f.type) for f in arrow], fields=list(arrow))

    return run


def unsigned_bytes(text: Column) -> Column:
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``, 0 for null: the white space that follows a word or begins the text, counted in one pass."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")
