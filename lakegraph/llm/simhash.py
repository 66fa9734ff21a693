"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is cut into equal segments. Two fingerprints that differ in at most ``k`` bits differ in at most
``k // segments`` bits of some segment, so for up to two bits a segment it is enough that each side enumerates the ball
of radius one around its segment value: the balls then share a key. Every fingerprint goes to the table under each key
of its balls; inside a key's bucket complete distances are verified. Buckets give spanning links, not all pairs, and
buckets above a bound are dealt out again in blocks. Links end in connected components by min-label hooking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import SLICE, map_texts, set_aside, written

SEED = 42
#: Rows of one bucket that one task verifies at once; larger buckets are dealt out in blocks of half as many.
BUCKET = 8192


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 votes, bit 63 first."""
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return votes


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle (A-Z lower-cased, single spaces), repeats included; shorter texts are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = list(zip(starts, ends[width - 1 :].tolist(), strict=False)) if len(words) >= width else [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(spans))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit value: a bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    return int(np.packbits((2 * _bits(hashes) > len(hashes)).astype(np.uint8)).view(">i8")[0])


def fingerprints(df: DataFrame, text: str, width: int) -> DataFrame:
    """Replaces column ``text`` by its fingerprint ``_f0``."""

    def make(texts: list[bytes | None]) -> dict[str, list]:
        return {"_f0": [fingerprint(shingle_hashes(t, width)) for t in texts]}

    return map_texts(df, text, "_f0 long", make)


def spanning_links(f: np.ndarray, near: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (a < b by index) that join what linked pairs join; at most one for each row but the first of its group."""
    left, tails, heads = np.arange(len(f)), [], []
    while len(left):
        front, left, root = left[:1], left[1:], left[0]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for s in range(0, len(front), block):
                hit |= (np.bitwise_count(f[front[s : s + block], None] ^ f[None, left]) <= near).any(0)
            front, left = left[hit], left[~hit]
            heads.append(front)
            tails.append(np.full(len(front), root))
    return (np.concatenate(tails), np.concatenate(heads)) if heads else (np.zeros(0, int), np.zeros(0, int))


def _scan(keys: list[str], near: int, bucket: int | None):
    """Reads ``_f0`` sorted by the key columns; yields links ``a, b`` and, beyond ``bucket`` rows of a key, the rows again under ``hot``."""
    names = ["a", "b", "hot", "_f0"]

    def rows_of(f: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(f), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(f.view(np.int64))], names=names)

    def links_of(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, spilling = np.zeros((0, len(keys)), np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            column = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            k, f = np.stack([column[c] for c in keys], 1), column["_f0"].view(np.uint64)
            if spilling is not None:  # the rest of a bucket that is dealt out again
                other = (k != spilling).any(1)
                same = int(other.argmax()) if other.any() else len(k)
                if same:
                    yield rows_of(f[:same], k[:same, 0])
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                spilling = None
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            edges = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            last = int(edges[-1]) if len(edges) else 0
            yield from buckets(k[:last], f[:last], edges[:-1])
            held_k, held_f = k[last:], f[last:]
            if bucket and len(held_k) > bucket:
                yield rows_of(held_f, held_k[:, 0])
                spilling, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
        if len(held_k):
            yield from buckets(held_k, held_f, np.zeros(0, int))

    def buckets(k: np.ndarray, f: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Complete buckets."""
        starts, stops = np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(f)]]).astype(int)
        sizes, a, b = stops - starts, [], []
        two = starts[sizes == 2]
        if len(two):
            ok = np.bitwise_count(f[two] ^ f[two + 1]) <= near
            a.append(f[two[ok]])
            b.append(f[two[ok] + 1])
        for i in np.flatnonzero(sizes > 2):
            part = f[starts[i] : stops[i]]
            if bucket and len(part) > bucket:
                yield rows_of(part, k[starts[i] : stops[i], 0])
                continue
            tails, heads = spanning_links(part, near)
            if len(heads):
                a.append(part[tails])
                b.append(part[heads])
        if a:
            yield links_of(a, b)

    return run


def links(prints: DataFrame, segments: int, near: int, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that join the distinct fingerprints ``_f0`` as all pairs within the limit would."""
    if near // segments > 2:
        raise ValueError("two balls of radius one meet only for up to two bits a segment")
    width = 64 // segments
    mask = F.lit((1 << width) - 1).cast("long")

    def keys(s: int):
        part = F.shiftrightunsigned("_f0", s * width).bitwiseAND(mask)
        flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
        return F.when(F.col("_bit") < 0, part).otherwise(part.bitwiseXOR(flip)) * segments + s

    bits = F.explode(F.sequence(F.lit(-1), F.lit(width - 1)))
    table = prints.select("_f0", bits.alias("_bit")).select(F.explode(F.array(*(keys(s) for s in range(segments)))).alias("key"), "_f0")
    schema = "a long, b long, hot long, _f0 long"
    first = written(table.repartition("key").sortWithinPartitions("key", "_f0").mapInArrow(_scan(["key"], near, bucket), schema), "links")
    hot = first.where("hot is not null").select(F.col("hot").alias("key"), "_f0")
    found = first.where("a is not null").select("a", "b")
    if not hot.isEmpty():
        # Each row meets each block of its bucket once: block pairs (i, j) with i <= j, a bounded number of rows each.
        counts = written(hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket / 2)).cast("long").alias("_n")), "hot-buckets")
        dealt = hot.join(counts, "key")
        pairs = dealt.withColumn("_own", F.pmod(F.xxhash64("_f0", F.lit(7)), F.col("_n"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        pairs = pairs.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_f0")
        again = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "_f0").mapInArrow(_scan(["key", "i", "j"], near, None), schema)
        found = found.unionByName(again.select("a", "b"))
    # A group's buckets give its members several roots: each member keeps its least root, and the roots link to it.
    found = written(found.distinct(), "distinct-links")
    least = found.groupBy("b").agg(F.min("a").alias("m"))
    roots = found.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    return least.select(F.col("m").alias("a"), "b").unionByName(roots)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for all ends of links ``a, b``: the least node that can be reached, by hooking and pointer jumping.

    Rounds grow with the logarithm of the longest chain. Hot nodes and labels only meet partial minima, and joins of plain
    written tables, whose partitions Spark splits where they are skewed.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("seen"))
        hooked = written(labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "seen").alias("low")), "hooked")
        if hooked.where("low <> label").isEmpty():
            return hooked.select("node", "label")
        # A node's old root also takes the least label seen below it, so that whole trees move at once.
        roots = written(hooked.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("moved")), "roots")
        moved = hooked.join(roots, hooked.low == roots.root, "left")
        labels = written(moved.select("node", F.least("low", F.coalesce("moved", "low")).alias("label")), "labels")


OUT = "_f0 long, _least long, _component long, _of long"


def near_duplicates(docs: DataFrame, width: int, segments: int, near: int, bucket: int = BUCKET) -> DataFrame:
    """Adds ``_f0`` and ``_component`` to rows with ``_id`` and ``_text``: the least ``_id`` that can be reached through links.

    Fingerprints link when they differ in at most ``near`` bits. Texts without words have fingerprint 0 and link like any
    other. Null ids have a component if any linked row has an id, else null. Repeated rows fall into one component; an
    empty table stays empty. Exact copies collapse to one fingerprint before any candidate is looked up. A caller's column
    with an output column's name goes on under its name and ``_given``.
    """
    table = written(fingerprints(set_aside(docs, OUT), "_text", width), "fingerprints")
    prints = written(table.groupBy("_f0").agg(F.min("_id").alias("_least")), "prints")
    labels = components(links(prints.select("_f0"), segments, near, bucket))
    named = written(prints.join(labels, prints._f0 == labels.node, "left").select("_f0", "_least", F.coalesce("label", "_f0").alias("_label")), "named")
    least = written(named.groupBy("_label").agg(F.min("_least").alias("_component")), "least")
    member = named.join(least, "_label").select(F.col("_f0").alias("_of"), "_component")
    return table.join(member, F.col("_f0") == F.col("_of")).drop("_of")


def document_components(docs: DataFrame) -> DataFrame:
    """The query's digest: four-word shingles, 64 bits in two segments, links at 4 or fewer differing bits."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    out = near_duplicates(rows, width=4, segments=2, near=4)
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_f0"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


#: The pipeline's stage: word shingles of this width link documents from this Jaccard similarity on.
WIDTH, SIMILAR = 5, 0.8
#: Segments of a set's long fingerprint and bits of each: a pair at similarity 0.8, whose bits differ with probability 0.15, shares
#: none with probability (1 - 0.85 ** 14) ** 160 = 5e-8. Small sets, whose bits differ more, have twice as many.
SEGMENTS, WIDE, SMALL = 160, 14, 5
#: What shares a segment is looked at if at most so many bits of the first 12 segments (3 words) differ; 25 on average at 0.8, deviation 4.6.
HEAD, FAR = 3, 53
#: Nodes of large buckets are looked at only if at most so many of all bits differ, where both sets have over SMALL shingles: at 0.8
#: they differ with probability 0.16 at most (12 of 13 and 14 shingles shared, by their oddness), deviation 17.4, so that 2e-10 are beyond it.
ALIKE = 470
#: Segments of the rounds: those before FULL only compare neighbours, the others all rows of a bucket that no earlier round has joined.
#: The first round of the others has the head's segments.
ROUNDS, FULL = ((0, 16), (16, 48), (0, 4 * HEAD), (4 * HEAD, SEGMENTS // 2), (SEGMENTS // 2, 2 * SEGMENTS)), 2
#: Rows of a bucket that list all their pairs; in larger ones many pairs are compared as a block, large ones in blocks of half as many.
FEW, BLOCK = 8, 1024
#: Buckets of up to so many rows are compared together.
TOGETHER = 64
_SALT, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 2 * SEGMENTS * WIDE // 64), np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the stage's shingles."""
    return np.unique(shingle_hashes(text, WIDTH))


def long_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of a set with new hashes for each 64 bits, as segments of 16 bits whose upper two are 0; empty for an empty set.

    A bit is 1 if it is set in over half of the hashes.
    """
    if not len(shingles):
        return b""
    count = SEGMENTS * (1 + (len(shingles) <= SMALL))
    words = count * WIDE // 64
    votes = np.zeros(64 * words, np.int64)
    for start in range(0, len(shingles), 128):
        h = (shingles[start : start + 128, None] ^ _SALT[:words]) * (_ODD[:words] | np.uint64(1))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        votes += np.unpackbits((h ^ (h >> np.uint64(29))).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return ((2 * votes > len(shingles)).reshape(count, WIDE) @ (1 << np.arange(WIDE))).astype(np.uint16).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``SIMILAR`` or more."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared >= SIMILAR * (len(a) + len(b) - shared)


def similar_spans(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links by index that join what the similar pairs join; every pair that they do not join already is compared."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark, left, tails, heads = np.zeros(int(ids.max()) + 1, bool), np.arange(len(sets)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            fits = left[np.minimum(sizes[left], sizes[x]) >= SIMILAR * np.maximum(sizes[left], sizes[x])]
            if len(fits):
                shared = np.add.reduceat(mark[np.concatenate([ids[starts[i] : starts[i] + sizes[i]] for i in fits])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[fits])[:-1]]))
                hit = fits[shared >= SIMILAR * (sizes[fits] + sizes[x] - shared)]
                tails += [x] * len(hit)
                heads += hit.tolist()
                front += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
            mark[own] = False
    return tails, heads


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))


def _block_links(table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_numpy()
    tails, heads = similar_spans([np.frombuffer(x, np.uint64) for x in table.column("_set").to_pylist()])
    return pa.table({"a": nodes[tails], "b": nodes[heads]})


_HEAD = [f"w{i}" for i in range(HEAD)]


def _segments(first: int, last: int):
    """Rows ``key, node, label``, the head words and ``full``, one for each segment from ``first`` to ``last`` of ``_print``.

    ``full`` is the whole fingerprint of ``_crowded`` nodes that have over ``SMALL`` shingles, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                prints = batch.column("_print").to_pylist()
                sizes = np.fromiter(map(len, prints), np.int64, len(prints)) // 2
                for size in np.unique(sizes[sizes > first]).tolist():
                    at = np.flatnonzero(sizes == size)
                    raw = b"".join(prints[i] for i in at)
                    part = np.frombuffer(raw, np.uint16).reshape(len(at), size)[:, first:last]
                    head = np.frombuffer(raw, np.int64).reshape(len(at), -1)[:, :HEAD]
                    key = (np.arange(first, first + part.shape[1], dtype=np.int32) << 16) | part
                    columns = [batch.column(c).to_numpy()[at] for c in ("node", "label")] + list(head.T)
                    crowded = batch.column("_crowded").to_numpy(zero_copy_only=False)[at] & (size == SEGMENTS)
                    full = pa.array([prints[i] if c else None for i, c in zip(at, crowded, strict=True)], pa.binary())
                    columns = [pa.array(np.repeat(c, part.shape[1])) for c in columns] + [full.take(pa.array(np.repeat(np.arange(len(at)), part.shape[1])))]
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *columns], names=["key", "node", "label", *_HEAD, "full"])

    return run


ROWS = "node long, label long, " + ", ".join(f"{w} long" for w in _HEAD) + ", full binary"
CANDIDATES = "a long, b long, hot long, " + ROWS.partition(", ")[2]


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows ``label, head words`` have different labels and heads that are near."""
    return (x[..., 0] != y[..., 0]) & (sum(np.bitwise_count((x[..., i] ^ y[..., i]).view(np.uint64)) for i in range(1, HEAD + 1)) <= FAR)


def _new(segment: np.ndarray, heads: np.ndarray, full: pa.Array):
    """Which pairs of rows by index share no earlier segment that both rows show and, where both are full, differ in at most ``ALIKE`` bits.

    What shares an earlier segment was looked at there.
    """
    have = full.is_valid().to_numpy(zero_copy_only=False)
    at, prints = np.cumsum(have) - 1, np.frombuffer(b"".join(full.drop_null().to_pylist()), np.uint16).reshape(-1, SEGMENTS)

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for s in range(0, len(x), 8192):
            t, h = x[s : s + 8192], y[s : s + 8192]
            good = ~(((heads[t] ^ heads[h]).view(np.uint16) == 0) & (np.arange(4 * HEAD) < segment[t, None])).any(1)
            both = np.flatnonzero(good & have[t] & have[h])
            differ = prints[at[t[both]]] ^ prints[at[h[both]]]
            met = ((differ == 0) & (np.arange(SEGMENTS) < segment[t[both], None])).any(1)
            good[both] = ~met & (np.bitwise_count(differ).sum(1, dtype=np.int64) <= ALIKE)
            ok[s : s + 8192] = good
        return ok

    return test


def _candidates(keys: list[str], neighbours: bool, few: int, bucket: int | None):
    """Reads rows sorted by the key columns; yields pairs ``a, b`` that are near in a bucket and not joined yet.

    Unless only neighbours are compared, pairs that share an earlier segment are left to it as far as the rows show that.
    A bucket of more than ``few`` rows with more such pairs than half of its rows is given as its rows ``hot, a`` instead; beyond
    ``bucket`` rows it comes again with all its columns.
    """
    names, m = [c.split()[0] for c in CANDIDATES.split(", ")], len(keys)

    def out(*columns: np.ndarray | pa.Array | None) -> pa.RecordBatch:
        n = len(next(c for c in columns if c is not None))
        columns += (None,) * (len(names) - len(columns))
        kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c) for c, t in zip(columns, kinds, strict=True)], names=names)

    def as_block(nodes: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return out(nodes, None, np.full(len(nodes), xxhash.xxh64_intdigest(key.tobytes(), SEED) - (1 << 63)))

    def again(x: np.ndarray, full: pa.Array) -> pa.RecordBatch:
        return out(x[:, m], None, x[:, 0], *x[:, m + 1 :].T, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_full, spilling = np.zeros((0, m + 2 + HEAD), np.int64), pa.nulls(0, pa.binary()), None
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = np.stack([column[c].to_numpy().astype(np.int64, copy=False) for c in (*keys, "node", "label", *_HEAD)], 1)
            full = column["full"].cast(pa.binary())
            if spilling is not None:  # the rest of a bucket that comes again
                other = (x[:, :m] != spilling).any(1)
                same = int(other.argmax()) if other.any() else len(x)
                if same:
                    yield again(x[:same], full[:same])
                x, full, spilling = x[same:], full[same:], spilling if same == len(x) else None
            x, full = np.concatenate([held, x]), pa.concat_arrays([held_full, full])
            edges = np.flatnonzero((x[1:, :m] != x[:-1, :m]).any(1)) + 1
            last = int(edges[-1]) if len(edges) else 0
            if neighbours:
                yield from buckets(x, full, edges)
                held, held_full = x[-1:], full[len(x) - 1 :]
                continue
            yield from buckets(x[:last], full[:last], edges[:-1])
            held, held_full = x[last:], full[last:]
            if bucket and len(held) > bucket:
                yield again(held, held_full)
                spilling, held, held_full = held[0, :m].copy(), held[:0], held_full[:0]
        if len(held) and not neighbours:
            yield from buckets(held, held_full, np.zeros(0, int))

    def buckets(x: np.ndarray, full_prints: pa.Array, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, stops = np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(x)]]).astype(int)
        node, rest, ends, sizes = x[:, m], x[:, m + 1 :], np.repeat(stops, stops - starts), stops - starts
        new = (lambda t, h: np.ones(len(t), bool)) if neighbours else _new(x[:, 0] >> 16, np.ascontiguousarray(rest[:, 1:]), full_prints)
        at, step, tails, heads = np.flatnonzero(np.repeat(neighbours | (sizes <= TOGETHER), sizes)), 1, [], []
        while len(at := at[at + step < ends[at]]):
            hit = at[_near(rest[at], rest[at + step])]
            hit = hit[new(hit, hit + step)]
            tails.append(hit)
            heads.append(hit + step)
            step += 1
            if neighbours:
                break
        if tails:
            t, h = np.concatenate(tails), np.concatenate(heads)
            own = np.searchsorted(starts, t, "right") - 1
            full = (2 * np.bincount(own, minlength=len(sizes)) > sizes) & (sizes > few) & (not neighbours)
            for i in np.flatnonzero(full):
                met = np.unique(np.concatenate([t[own == i], h[own == i]]))
                yield as_block(node[met], x[starts[i], :m])
            tails, heads = [node[t[~full[own]]]], [node[h[~full[own]]]]
        for i in () if neighbours else np.flatnonzero(sizes > TOGETHER):
            part, ids = rest[starts[i] : stops[i]], node[starts[i] : stops[i]]
            if (part[:, 0] == part[0, 0]).all():
                continue
            if bucket and len(part) > bucket:
                yield again(x[starts[i] : stops[i]], full_prints[starts[i] : stops[i]])
                continue
            met, found, count = np.zeros(len(part), bool), [], 0
            for s in range(0, len(part), 256):
                t, h = np.nonzero(np.triu(_near(part[s : s + 256, None], part[None, s:]), 1))
                kept = new(t + s + starts[i], h + s + starts[i])
                t, h = t[kept], h[kept]
                met[t + s] = met[h + s] = True
                count += len(t)
                if 2 * count <= len(part) or len(part) <= few:
                    found.append((ids[t + s], ids[h + s]))
            if 2 * count > len(part) > few:
                yield as_block(ids[met], x[starts[i], :m])
            else:
                tails += [t for t, _ in found]
                heads += [h for _, h in found]
        if sum(map(len, tails)):
            a, b = np.concatenate(tails), np.concatenate(heads)
            yield out(np.minimum(a, b), np.maximum(a, b))

    return run


def _blocks(n: str, block: int):
    """Deals rows out by the hash of their ``node``: each row meets each block of its bucket once, block pairs ``i <= j``."""
    count = F.when(F.col(n) <= block, 1).otherwise(F.ceil(F.col(n) / F.lit(block / 2))).cast("long")

    def deal(df: DataFrame, *columns: str) -> DataFrame:
        dealt = df.withColumn("_n", count).withColumn("_own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_n"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        return dealt.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), *columns)

    return deal


def candidates(nodes: DataFrame, first: int, last: int, neighbours: bool, few: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` and bucket rows ``key, node, n``: what shares one of the segments, is near by its head and differs in ``label``.

    Unless only neighbours are compared, what shares one of the head's segments must have been looked at before or be looked at now, as
    must what shares any earlier one where nodes are ``_crowded`` (may be missing): no pair is met in those again.
    """
    if "_crowded" not in nodes.columns:
        nodes = nodes.withColumn("_crowded", F.lit(False))
    rows = nodes.mapInArrow(_segments(first, last), "key int, " + ROWS)
    laid = rows.repartition("key").sortWithinPartitions("key", *(_HEAD[:1] if neighbours else []))
    found = written(laid.mapInArrow(_candidates(["key"], neighbours, few, None if neighbours else bucket), CANDIDATES), "candidates")
    over = found.where("w0 is not null")
    if not over.isEmpty():
        rows = over.withColumnsRenamed({"hot": "key", "a": "node"}).drop("b")
        dealt = _blocks("n", bucket)(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key"), "node", "label", *_HEAD, "full")
        more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_candidates(["key", "i", "j"], False, few, None), CANDIDATES)
        found = found.where("w0 is null").unionByName(written(more, "candidates-of-blocks"))
    pairs = written(found.where("b is not null").select("a", "b").distinct(), "pairs")
    hot = found.where("b is null").select(F.col("hot").alias("key"), F.col("a").alias("node"))
    return pairs, written(hot.join(hot.groupBy("key").agg(F.count("*").alias("n")), "key"), "buckets")


def verified(nodes: DataFrame, texts: DataFrame, pairs: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    """``a, b``: links that join what the pairs and the rows of each bucket with similarity ``SIMILAR`` join."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct()
    chosen = nodes.select("node", "_tie").join(wanted, "node")
    found = texts.join(chosen, "_tie").select("node", "_text").dropDuplicates(["node"])
    sets = written(map_texts(found, "_text", "_set binary", lambda ts: {"_set": [shingle_set(t).tobytes() for t in ts]}), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("_set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("_set").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")
    if not hot.isEmpty():
        dealt = _blocks("n", block)(hot, "node").join(sets, "node")
        links = links.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long"))
    return written(links.distinct(), "similar")


def similar_links(nodes: DataFrame, texts: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """``a, b``: verified links that join what the pairs with a common segment, near heads and similarity ``SIMILAR`` join.

    ``nodes`` has ``node, _tie, _print``, one row for each set of shingles; ``texts`` has ``_tie, _text``. The first rounds
    only look at neighbours in the index, which joins most copies by few comparisons; the others look at all pairs of all
    segments whose ends are not joined yet. Nodes that large buckets had in the head's segments go on with their whole
    fingerprints, so that members of a large group meet in their first common segment only.
    """
    links, crowded, labelled = None, None, nodes.select("node", F.col("node").alias("label"), "_print")
    for k, (first, last) in enumerate(ROUNDS):
        if links is not None:
            labels = components(links).withColumnRenamed("node", "_node")
            labelled = nodes.join(labels, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("label", "node").alias("label"), "_print")
        if crowded is not None:
            labelled = labelled.join(crowded, F.col("node") == F.col("_of"), "left").withColumn("_crowded", F.col("_of").isNotNull()).drop("_of")
        pairs, hot = candidates(labelled, first, last, k < FULL, few, 8 * block)
        if k == FULL:
            crowded = written(hot.select(F.col("node").alias("_of")).distinct(), "crowded")
        found = verified(nodes, texts, pairs, hot, block)
        links = found if links is None else links.unionByName(found)
    return links


def distinct_rows(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id, and of equal ids the least by the hash of all its columns.

    Groups are the components of all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    A multi-index over the segments of long SimHash fingerprints finds the candidates, the sets decide. Documents with equal
    sets are one node; texts without words too.
    Null ids come last, so that a group keeps a document with an id where it has one; rows that are equal in all columns
    are one. Columns pass as they came, whatever their names; an empty table stays empty. All decisions are made on narrow
    rows, which know a document by its id and the hash of all its columns.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id")).withColumn("_tie", F.xxhash64("_doc"))

    def make(texts: list[bytes | None]) -> dict[str, list]:
        sets = [shingle_set(t) for t in texts]
        return {"node": [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], "_print": [long_fingerprint(s) for s in sets]}

    texts = packed.select("_id", "_tie", F.col("_doc.text").alias("_text"))
    table = written(map_texts(texts, "_text", "node long, _print binary", make), "long-fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_tie")).alias("w")
    nodes = written(table.groupBy("node").agg(first, F.first("_print").alias("_print")), "nodes")
    labels = components(similar_links(nodes.select("node", "w._tie", "_print"), texts.select("_tie", "_text"))).withColumnRenamed("node", "_node")
    member = nodes.join(labels, F.col("node") == F.col("_node"), "left").select("w", F.coalesce("label", "node").alias("_label"))
    winners = member.groupBy("_label").agg(F.min("w").alias("w")).select(F.col("w._id").alias("_kid"), F.col("w._tie").alias("_ktie"))
    same = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_tie") == F.col("_ktie"))
    # Rows that are equal in all columns are as one only where a winner has some; the others need no further exchange.
    copies = table.groupBy("_id", "_tie").agg(F.count("*").alias("_n")).where("_n > 1")
    keep = written(winners.join(copies, same, "left").select("_kid", "_ktie", F.col("_n").isNotNull().alias("_twice")), "winners")
    kept = packed.join(keep.where("not _twice"), same, "left_semi")
    if not keep.where("_twice").isEmpty():
        kept = kept.unionByName(packed.join(keep.where("_twice"), same, "left_semi").dropDuplicates(["_id", "_tie"]))
    return kept.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
