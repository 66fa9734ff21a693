"""How far the sources of each language are from each other, by two-dimensional tiling of their packed count vectors.

Terms are counted for each group (language and source). The kept terms of all languages stand in one order that is cut
into chunks, and a group has one packed vector of counts for each chunk. The groups of a language are cut into blocks;
each vector is replicated to the tiles (pairs of blocks) of its block. A task goes through a tile's vectors by
successive chunks, holds one chunk at a time and adds up the tile's submatrix of pairs, both directions.

All arithmetic is exact in 64 bits as long as a group has less than 9e15 occurrences and a language less than 1e9 kept terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.llm.common import positions, written

#: What stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that a task splits at once; one text may have more.
PART_BYTES = 8 << 20
UNIT = 1_000_000_000
#: Documents of a language that a kept term is in at least, and the ranks of terms that are reported.
MIN_DOCS, TOP = 3, 200
#: Terms in a chunk, groups in a block, and successive chunks that one task goes through.
WIDTH, BLOCK, SPAN = 8192, 32, 64


COUNTS = "_lang string, _source string, _term string, _n long, _docs long"


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    return starts, np.diff(starts, append=len(ordered))


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PART_BYTES`` of text."""
    part = np.cumsum(pc.binary_length(batch.column(2)).to_numpy()) // PART_BYTES
    starts, sizes = runs(part)
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        yield batch.slice(start, size)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``COUNTS`` of some documents at a time, and a row without term for each of their groups."""
    for batch in (part for whole in batches for part in small(whole)):
        lang, source, text = batch.columns
        words = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
        coded = words.flatten().dictionary_encode()
        empty, size = pc.index(coded.dictionary, "").as_py(), max(1, len(coded.dictionary))
        code = coded.indices.to_numpy().astype(np.int64)
        row = pc.list_parent_indices(words).to_numpy()[code != empty]
        of_lang, of_source = (c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (lang, source))
        _, first, group = np.unique(of_lang * batch.num_rows + of_source, return_index=True, return_inverse=True)

        in_rows = np.sort(row * size + code[code != empty])
        starts, n = runs(in_rows)
        row, code = np.divmod(in_rows[starts], size)
        in_groups = group[row] * size + code
        order = np.argsort(in_groups)
        starts, docs = runs(in_groups[order])
        n = np.add.reduceat(n[order], starts) if len(starts) else n
        group, code = np.divmod(in_groups[order][starts], size)

        at = pa.array(np.concatenate([first[group], first]))
        none, zero = pa.nulls(len(first), pa.string()), np.zeros(len(first), np.int64)
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(code)), none])
        arrays = [lang.take(at), source.take(at), terms, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))]
        yield pa.RecordBatch.from_arrays(arrays, names=["_lang", "_source", "_term", "_n", "_docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``COUNTS`` from ``_lang, _source, _text``, with a row without term for each group; summed in tasks before the shuffle."""
    return docs.mapInArrow(count_terms, COUNTS).groupBy("_lang", "_source", "_term").agg(F.sum("_n").alias("_n"), F.sum("_docs").alias("_docs"))


def share(count: np.ndarray | int, whole: int) -> np.ndarray:
    """``1 + floor(1e9 * (count + 1) / whole)`` by long division, three digits at a time, without leaving 64 bits."""
    digit, rest = np.divmod(np.asarray(count, np.int64) + 1, np.int64(whole))
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, np.int64(whole))
        digit = digit * 1000 + more
    return 1 + digit


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Vector:
    """One group's part of a chunk: places of its terms, their shares, and the share of a term that it hasn't."""

    def __init__(self, at: np.ndarray, count: np.ndarray, whole: int):
        self.at, self.p, self.absent = at, share(count, whole) if len(at) else np.zeros(0, np.int64), share(0, whole) if whole else np.int64(1)


def submatrix(left: list[Vector], right: list[Vector], width: int) -> np.ndarray:
    """Sums of distances over a chunk's terms, from each of ``left`` to each of ``right``; only terms that occur are looked at.

    For each left group all terms count as absent first; then those that it has are exchanged.
    """
    dense = np.empty((len(right), width), np.int64)
    for row, h in zip(dense, right, strict=True):
        row[:] = h.absent
        row[h.at] = h.p
    flat = np.concatenate([h.p for h in right])
    ends = np.cumsum([len(h.p) for h in right])
    sizes = np.diff(ends, prepend=0)
    absent = np.array([h.absent for h in right], np.int64)
    out = np.empty((len(left), len(right)), np.int64)
    for k, g in enumerate(left):
        sums = np.concatenate([[0], np.cumsum(distance(g.absent, flat))])
        others = dense[:, g.at]
        out[k] = sums[ends] - sums[ends - sizes] + (width - sizes) * distance(g.absent, absent) + (distance(g.p, others) - distance(g.absent, others)).sum(1)
    return out


PAIRS = "_lang string, _source string, _other string, _value long"


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Submatrices of the tiles of a partition that is sorted by tile and chunk; one chunk of one tile is in memory."""
    tile, chunk, members = None, None, {0: {}, 1: {}}
    sums: dict[tuple[str, str], int] = {}

    def add(width: int) -> None:
        low, high = members[0], members[1] or members[0]
        for a, b in [(low, high)] + ([(high, low)] if high is not low else []):
            part = submatrix(list(a.values()), list(b.values()), width)
            for g, row in zip(a, part.tolist(), strict=True):
                for h, v in zip(b, row, strict=True):
                    if g != h:
                        sums[g, h] = sums.get((g, h), 0) + v

    def close() -> Iterator[pa.RecordBatch]:
        if sums:
            yield pa.RecordBatch.from_pydict({"_lang": [tile[0]] * len(sums), "_source": [g for g, _ in sums], "_other": [h for _, h in sums], "_value": pa.array(sums.values(), pa.int64())})
            sums.clear()

    width = 0
    for batch in batches:
        col = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        plain = {n: col[n].to_pylist() for n in ("_lang", "_i", "_j", "_span", "_chunk", "_source", "_block", "_whole", "_width")}
        for k in range(batch.num_rows):
            here = tuple(plain[n][k] for n in ("_lang", "_i", "_j", "_span"))
            if (here, plain["_chunk"][k]) != (tile, chunk):
                if tile is not None:
                    add(width)
                    if here != tile:
                        yield from close()
                tile, chunk, members, width = here, plain["_chunk"][k], {0: {}, 1: {}}, plain["_width"][k]
            at, count = (col[n][k].values for n in ("_at", "_count"))
            arrays = (x.to_numpy(zero_copy_only=False) if x is not None else np.zeros(0, np.int64) for x in (at, count))
            members[int(plain["_block"][k] != here[1])][plain["_source"][k]] = Vector(*arrays, plain["_whole"][k])
    if tile is not None:
        add(width)
        yield from close()


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances between all sources of a language, and each source's ``top`` terms beyond its language.

    Null language, source and text are empty strings; groups without any term and languages without kept terms have
    their pairs too (value 0 without kept terms). Repeated rows count each. An empty table gives no rows. Further columns
    of ``docs`` are not looked at. Ties are ranked by the item's UTF-8 bytes.
    """
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "_lang"), (source, "_source"), (text, "_text"))))
    counts = written(term_counts(docs), "term-counts")
    known = counts.where(F.col("_term").isNotNull()).groupBy("_lang", "_term").agg(F.sum("_n").alias("_all"), F.sum("_docs").alias("_docs")).where(F.col("_docs") >= min_docs)
    vocabulary = positions(known.select("_lang", "_term", "_all"), ["_lang", "_term"], "vocabulary").withColumns({"_chunk": F.expr(f"_pos div {WIDTH}"), "_at": F.expr(f"_pos % {WIDTH}")}).drop("_pos")
    kept = written(counts.where(F.col("_n") > 0).select("_lang", "_source", "_term", "_n").join(vocabulary, ["_lang", "_term"]), "kept-terms")

    # one row a chunk of a language, one a language, one a group: small beside the counts
    chunks = vocabulary.groupBy("_lang", "_chunk").agg(F.count("*").alias("_terms"), F.min("_at").alias("_first"), F.sum("_all").alias("_sum"))
    langs = chunks.groupBy("_lang").agg(F.sum("_terms").alias("_v"), F.sum("_sum").alias("_n_lang"))
    sums = kept.groupBy("_lang", "_source").agg(F.sum("_n").alias("_n_group"))
    groups = counts.select("_lang", "_source").distinct().join(sums, ["_lang", "_source"], "left").join(langs, "_lang", "left").na.fill(0, ["_n_group", "_v", "_n_lang"])
    groups = groups.withColumn("_block", F.expr(f"(row_number() over (partition by _lang order by _source) - 1) div {BLOCK}").cast("int"))
    groups = written(groups.withColumn("_last", F.expr("max(_block) over (partition by _lang)")), "groups")

    # every group has a vector for every chunk of its language, or an empty one where the language keeps no term
    packed = kept.groupBy("_lang", "_source", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_v_n"))
    frame = groups.join(chunks.select("_lang", "_chunk", "_terms", "_first"), "_lang", "left").na.fill(-1, ["_chunk"]).na.fill(0, ["_terms", "_first"])
    vectors = frame.join(packed, ["_lang", "_source", "_chunk"], "left").select(
        "_lang", "_source", "_block", "_chunk", F.col("_terms").alias("_width"), (F.col("_n_group") + F.col("_v")).alias("_whole"), F.explode(F.sequence(F.lit(0), "_last")).alias("_o"),
        F.transform("_v_n", lambda x: x["_at"] - F.col("_first")).alias("_at"), F.col("_v_n._n").alias("_count"),
    )
    tile = ["_lang", "_i", "_j", "_span"]
    vectors = vectors.withColumns({"_i": F.least("_block", "_o"), "_j": F.greatest("_block", "_o"), "_span": F.expr(f"_chunk div {SPAN}")}).drop("_o")
    tiled = vectors.repartition(*tile).sortWithinPartitions(*tile, "_chunk", "_source")
    pairs = tiled.mapInArrow(tile_sums, PAIRS).groupBy("_lang", "_source", "_other").agg(F.sum("_value").alias("_value"))
    pairs = pairs.select("_lang", "_source", F.lit("pair").alias("_part"), F.col("_other").alias("_item"), "_value")

    p = lambda n, whole: F.expr(f"1 + cast({n} + 1 as decimal(20, 0)) * {UNIT} div {whole}")
    terms = kept.join(groups, ["_lang", "_source"]).withColumns({"_p": p("_n", "(_n_group + _v)"), "_q": p("_all", "(_n_lang + _v)")}).where(F.col("_p") > F.col("_q"))
    terms = terms.select("_lang", "_source", F.lit("term").alias("_part"), F.col("_term").alias("_item"), F.expr("(_p - _q) * (_p - _q) div _q").alias("_value"))

    rank = F.row_number().over(Window.partitionBy("_lang", "_source").orderBy(F.desc("_value"), "_item"))
    ranked = pairs.withColumn("_rank", rank).unionByName(terms.withColumn("_rank", rank).where(F.col("_rank") <= top))
    return ranked.select(*(F.col(f"_{c}").alias(c) for c in ("lang", "source", "part", "item", "value", "rank")))
