"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of a source that is to be repeated ``r`` times takes ``floor(r)`` copies and holds the rest as a copy
probability. Probabilities are rounded in pairs: mass (probability times size) moves at random from one document to the
other until one of the two is integral, which keeps every expectation and, exactly, the source's words. Bounded runs of
rows are folded in parallel; each run leaves at most one fractional document, and these residuals are folded again in
the next level of the tree until each source has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import positions, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Rows that one fold takes; a run of the reduction tree.
FAN_IN = 256
#: Source tables up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: weights repeat over the sources by code point (null last);
    targets stop at ``cap`` times the source's size and the excess is shared again until no target is above.

    Only sums come to the driver; the sources stay distributed. Sources without size have target 0.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = positions(summed.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_pos") % len(weights) + 1).cast("int"))
    table = written(placed.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")), "weights")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:  # each turn caps at least one more source
        stops = F.col("_cap") <= F.lit(level) * F.col("_w")
        held, n, free = table.agg(F.coalesce(F.sum(F.when(stops, F.col("_cap"))), F.lit(0.0)), F.count(F.when(stops, 1)), F.coalesce(F.sum(F.when(~stops, F.col("_w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    target = F.when(F.lit(bool(capped >= 0)), F.least(F.col("_cap"), F.lit(level) * F.col("_w"))) if level else F.col("_cap") * 0.0
    return table.select("source", "source_size", target.cast("double").alias("target"))


#: One step of a fold. ``h`` is the document that is still fractional, ``x`` the next one; ``up`` and ``down`` are the
#: masses that may move from x to h and back, and ``u`` is a uniform number fixed by the two rows and the seed.
_STEP = """
(acc, x) -> CASE WHEN acc.h IS NULL THEN named_struct('h', x, 'done', acc.done) ELSE
  transform(array(named_struct(
      'up', least((1D - acc.h.p) * acc.h.size, x.p * x.size),
      'down', least(acc.h.p * acc.h.size, (1D - x.p) * x.size),
      'u', (xxhash64({seed}, acc.h.pos, x.pos) & 9007199254740991L) / 9007199254740992D)),
    m -> CASE
      WHEN m.u * (m.up + m.down) < m.down THEN
        CASE WHEN (1D - acc.h.p) * acc.h.size <= x.p * x.size
          THEN named_struct('h', named_struct('pos', x.pos, 'p', greatest(0D, x.p - m.up / x.size), 'size', x.size),
                            'done', concat(acc.done, array(named_struct('pos', acc.h.pos, 'one', 1))))
          ELSE named_struct('h', named_struct('pos', acc.h.pos, 'p', least(1D, acc.h.p + m.up / acc.h.size), 'size', acc.h.size),
                            'done', concat(acc.done, array(named_struct('pos', x.pos, 'one', 0)))) END
      ELSE
        CASE WHEN acc.h.p * acc.h.size <= (1D - x.p) * x.size
          THEN named_struct('h', named_struct('pos', x.pos, 'p', least(1D, x.p + m.down / x.size), 'size', x.size),
                            'done', concat(acc.done, array(named_struct('pos', acc.h.pos, 'one', 0))))
          ELSE named_struct('h', named_struct('pos', acc.h.pos, 'p', greatest(0D, acc.h.p - m.down / acc.h.size), 'size', acc.h.size),
                            'done', concat(acc.done, array(named_struct('pos', x.pos, 'one', 1)))) END
      END)[0] END
"""


def _fold(rows: Column, seed: int) -> Column:
    return F.expr(
        f"aggregate(_rows, named_struct('h', cast(null as struct<pos:bigint,p:double,size:double>), 'done', cast(array() as array<struct<pos:bigint,one:int>>)), {_STEP.format(seed=seed)})"
    )


def pivotal_rounding(rows: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """``pos, one`` (0 or 1) for ``source, pos, p, size`` with 0 < p < 1, size > 0 and distinct ``pos``.

    Rows with equal ``source`` keep their sum of ``p * size`` but for less than one row. A run has at most ``fan_in``
    rows, so one source may hold any share of the rows. Reruns give the same result.
    """
    decided, level = [], 0
    left = rows.select("source", "pos", "p", F.col("size").cast("double").alias("size"))
    while True:
        run = F.floor(F.col("pos") / F.lit(fan_in ** (level + 1))).alias("run")
        runs = left.groupBy("source", run).agg(F.sort_array(F.collect_list(F.struct("pos", "p", "size"))).alias("_rows"))
        folded = written(runs.select("source", _fold(F.col("_rows"), seed * 1000 + level).alias("f")).select("source", "f.h", "f.done"), "pivotal")
        decided.append(folded.select(F.explode("done").alias("d")).select("d.pos", "d.one"))
        n, sources = folded.agg(F.count("*"), F.count_distinct("source") + F.max(F.col("source").isNull().cast("int"))).first()
        left = folded.select("source", F.col("h.pos").alias("pos"), F.col("h.p").alias("p"), F.col("h.size").alias("size"))
        if n <= (sources or 0):
            break
        level += 1
    draw = F.expr(f"(xxhash64({seed * 1000 + 999}, pos) & 9007199254740991L) / 9007199254740992D")
    out = left.select("pos", (draw < F.col("p")).cast("int").alias("one"))
    for d in decided:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``_size`` (words), ``_source_size``, ``_target`` and ``_copies`` (0, 1 or 2) to rows with ``_source``, ``_words``, ``_id``.

    Null texts have no words and take ``floor`` copies of their ratio; null sources form one source; an empty table
    stays empty. Repeated rows are rounded each on its own. Names that begin with ``_`` are the operator's.
    """
    docs = positions(docs, [F.col("_source"), F.col("_words").desc(), F.col("_id"), F.col("_tie")], "mixed")
    targets = written(source_targets(docs.select(F.col("_source").alias("source"), F.col("_words").alias("size"))), "targets").select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    aimed = docs.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("_source_size") > 0, F.least(F.lit(CAP), F.col("_target") / F.col("_source_size"))).otherwise(0.0)
    aimed = aimed.withColumn("_whole", F.floor(ratio).cast("int")).withColumn("_p", ratio - F.floor(ratio))
    rounded = pivotal_rounding(aimed.where("_p > 0 and _words > 0").select(F.col("_source").alias("source"), F.col("_pos").alias("pos"), F.col("_p").alias("p"), F.col("_words").alias("size")), seed)
    both = aimed.join(rounded.withColumnRenamed("pos", "_pos"), "_pos", "left")
    return both.withColumn("_copies", F.col("_whole") + F.coalesce("one", F.lit(0))).drop("_whole", "_p", "one", "_pos")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The query's digest: a row for each document with the words that the mix takes from it. Texts are not shuffled."""
    narrow = docs.select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), word_count(F.col("text")).alias("_words"), F.crc32(F.encode("text", "UTF-8")).alias("_tie"))
    out = mix(narrow, seed)
    return out.select(F.col("_id").alias("doc_id"), F.col("_words").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_words") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), F.col("_source").alias("source"))


def mix_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Whole documents, each as often as the mix takes it, with the columns they came with.

    The mix is made on narrow rows, which know a document by its id and the hash of all its columns; texts meet their copies
    in one join. Rows that are equal in all columns share their copies. Null and empty texts have no words and are never
    taken; null sources are one source; an empty table stays empty. Columns may have any names; a map has no hash in Spark
    and isn't allowed.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id")).withColumn("_tie", F.xxhash64("_doc"))
    narrow = packed.select("_id", "_tie", F.col("_doc.source").cast("string").alias("_source"), word_count(F.col("_doc.text")).alias("_words"))
    taken = mix(narrow, seed).groupBy(F.col("_id").alias("_mid"), F.col("_tie").alias("_mtie")).agg(F.sum("_copies").cast("int").alias("_copies"), F.count("*").alias("_n")).where("_copies > 0")
    taken = written(taken, "copies")
    same = F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_tie") == F.col("_mtie"))
    both = packed.join(taken.where("_n = 1"), same).select("_doc", "_copies")
    if not taken.where("_n > 1").isEmpty():
        both = both.unionByName(packed.join(taken.where("_n > 1"), same).dropDuplicates(["_id", "_tie"]).select("_doc", "_copies"))
    return both.select("_doc", F.explode(F.sequence(F.lit(1), "_copies"))).select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
