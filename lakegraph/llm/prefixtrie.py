"""The trie of conversations' common prefixes, by most-significant-digit radix partitioning.

Turns (role and text) get ids from a dictionary; a conversation becomes an array of ids, and equal arrays become one
sequence with its number of conversations. A bucket holds the sequences that begin alike. Each round jumps to the end of
what a bucket's sequences share (the prefix that its least and greatest sequence share), emits the nodes on the way and
deals the bucket out by the next turn's id. A bucket that fits in a task is local: there multikey quicksort finishes it,
and each part of equal digits is a node. Sums over subtrees go from local buckets to the few nodes above.

Ids of a conversation's turns meet in one row, so that it may have some 1e8 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.llm.common import written

#: Turns of a bucket (after what its sequences share) that one task finishes; one sequence is always local.
LOCAL_TURNS = 16_384
#: Conversation ids that are joined before they meet those of the same sequence from other tasks.
RUN_IDS = 65_536
#: Conversations share up to HEAD - 1 first turns with the first of their FAMILY.
FAMILY, HEAD = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences_of_turns(turns: DataFrame) -> DataFrame:
    """``_conv, _ids, _lens``: each conversation's turn ids and code points from ``_conv, _turn, _role, _text``.

    Turns go by turn (null first), then role, then text; repeated turns stay. The order comes from a range sort, so that
    texts of one conversation needn't meet; the dictionary is joined by digests.
    """
    key = F.unhex(F.sha2(F.concat(F.char_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256))
    order = ["_conv", "_turn", "_role", "_text"]
    laid = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = written(laid.select("_conv", F.monotonically_increasing_id().alias("_mid"), key.alias("_key"), F.char_length("_text").alias("_len")), "turns")
    dictionary = written(laid.select("_key").distinct().withColumn("_id", F.monotonically_increasing_id()), "turn-dictionary")
    rows = laid.join(dictionary, "_key").groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_mid", "_id", "_len"))).alias("_rows"))
    return rows.select("_conv", F.col("_rows._id").alias("_ids"), F.col("_rows._len").alias("_lens"))


def rebuilt(convs: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """Exchanges the first h = crc32(id) % ``head`` turns for those of conversation ``_conv - _conv % family``, if there is one."""
    bases = convs.where(F.col("_conv") % family == 0).select(F.col("_conv").alias("_base"), F.slice("_ids", 1, head - 1).alias("_base_ids"), F.slice("_lens", 1, head - 1).alias("_base_lens"))
    h = (F.crc32(F.col("_conv").cast("string").cast("binary")) % head).cast("int")
    both = convs.withColumns({"_h": h, "_base": F.col("_conv") - F.col("_conv") % family}).join(bases, "_base", "left")

    def spliced(own: str, base: str) -> Column:
        return F.concat(F.coalesce(F.slice(base, F.lit(1), F.col("_h")), F.array().cast(both.schema[own].dataType)), F.slice(own, F.col("_h") + 1, F.greatest(F.size(own) - F.col("_h"), F.lit(0))))

    return both.select("_conv", spliced("_ids", "_base_ids").alias("_ids"), spliced("_lens", "_base_lens").alias("_lens"))


SEQUENCE = "_key binary, _first long, _n long, _members binary, _ids array<long>, _lens array<int>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sequence that follow each other become one row with their joined ids, up to ``RUN_IDS``."""
    key, members, first = None, [], None

    def row() -> pa.RecordBatch:
        joined = ",".join(map(str, members)).encode()
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([members[0]], pa.int64()), pa.array([len(members)], pa.int64()), pa.array([joined], pa.binary()), *first], names=["_key", "_first", "_n", "_members", "_ids", "_lens"])

    for batch in batches:
        keys, convs = batch.column("_key").to_pylist(), batch.column("_conv").to_pylist()
        for k, (this, conv) in enumerate(zip(keys, convs, strict=True)):
            if members and (this != key or len(members) >= RUN_IDS):
                yield row()
                members = []
            if not members:
                key, first = this, [batch.column(n).slice(k, 1) for n in ("_ids", "_lens")]
            members.append(conv)
    if members:
        yield row()


ENDED = "_ids array<long>, _lens array<int>, _n long, _conv long, _ends string"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a sequence, in order, go through one hash."""
    key, n, conv, digest, first = None, 0, None, hashlib.sha256(), None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*first, pa.array([n], pa.int64()), pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["_ids", "_lens", "_n", "_conv", "_ends"])

    for batch in batches:
        keys, firsts, sizes = (batch.column(c).to_pylist() for c in ("_key", "_first", "_n"))
        for k, this in enumerate(keys):
            if this != key:
                if key is not None:
                    yield row()
                key, n, conv, digest, first = this, 0, firsts[k], hashlib.sha256(), [batch.column(c).slice(k, 1) for c in ("_ids", "_lens")]
            elif n:
                digest.update(b",")
            digest.update(batch.column("_members")[k].as_py())
            n += sizes[k]
    if key is not None:
        yield row()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``_ids, _lens, _n`` (conversations), ``_conv`` (the least), ``_ends`` (SHA-256 of all their ids in order).

    A sequence of any share of the conversations is split by ranges of their ids; only joined ids meet for the hash.
    """
    keyed = convs.select(F.unhex(F.sha2(F.array_join("_ids", ","), 256)).alias("_key"), "_conv", "_ids", "_lens")
    runs = keyed.repartitionByRange("_key", "_conv").sortWithinPartitions("_key", "_conv").mapInArrow(_runs, SEQUENCE)
    return runs.repartition("_key").sortWithinPartitions("_key", "_first").mapInArrow(_ends, ENDED)


NODES = "_bucket string, _top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Trie:
    """Nodes of sequences that share their first ``depth`` + 1 turns, from depth ``depth`` + 1 on."""

    def __init__(self, ids: list[list[int]], lens: list[list[int]], n: list[int], conv: list[int], ends: list[str]):
        self.ids, self.lens, self.n, self.conv, self.digest = ids, lens, n, conv, ends
        self.parent, self.depth, self.convs, self.least, self.own, self.ends = [], [], [], [], [], []

    def node(self, part: list[int], depth: int, parent: int) -> int:
        n = sum(self.n[s] for s in part)
        self.parent.append(parent)
        self.depth.append(depth)
        self.convs.append(n)
        self.least.append(min(self.conv[s] for s in part))
        self.own.append((n - 1) * self.lens[part[0]][depth - 1])
        self.ends.append(NOTHING)
        return len(self.parent) - 1

    def sort(self, depth: int) -> None:
        """Multikey quicksort: a part is split by its turn at ``depth`` into less, equal and greater; the equal ones are a node."""
        stack = [(list(range(len(self.ids))), depth, -1)]
        while stack:
            part, depth, above = stack.pop()
            going = [s for s in part if len(self.ids[s]) > depth]
            if len(going) < len(part):
                self.ends[above] = next(self.digest[s] for s in part if len(self.ids[s]) == depth)
            if not going:
                continue
            pivot = self.ids[going[len(going) // 2]][depth]
            equal = [s for s in going if self.ids[s][depth] == pivot]
            if len(equal) < len(going):
                stack.append(([s for s in going if self.ids[s][depth] > pivot], depth, above))
                stack.append(([s for s in going if self.ids[s][depth] < pivot], depth, above))
            stack.append((equal, depth + 1, self.node(equal, depth + 1, above)))

    def sums(self) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and saved tokens of each node's subtree; a node stands after its parent."""
        children, leaves, saved = [0] * len(self.parent), [0] * len(self.parent), self.own.copy()
        for k in range(len(self.parent) - 1, -1, -1):
            leaves[k] = leaves[k] or 1
            above = self.parent[k]
            if above >= 0:
                children[above] += 1
                leaves[above] += leaves[k]
                saved[above] += saved[k]
        return children, leaves, saved


def _local(table: pa.Table) -> pa.Table:
    """Nodes of one local bucket."""
    col = {n: table.column(n).to_pylist() for n in ("_ids", "_lens", "_n", "_conv", "_ends")}
    trie = Trie(*col.values())
    bucket, depth, above = (table.column(n)[0].as_py() for n in ("_bucket", "_end", "_head_conv"))
    trie.sort(depth)
    children, leaves, saved = trie.sums()
    parents = [above if p < 0 else trie.least[p] for p in trie.parent]
    size = len(parents)
    arrays = [[bucket] * size, [p < 0 for p in trie.parent], trie.least, trie.depth, parents, trie.convs, children, leaves, saved, trie.ends]
    kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
    return pa.table([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def shared(low: str, high: str) -> Column:
    """How many first elements two arrays share."""
    differ = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, F.size(low)).otherwise(differ - 1).cast("int")


def _about(rows: DataFrame, keys: list[str], turns: Column) -> DataFrame:
    """What a round needs to know of each bucket; ``_stop`` is where its sequences part."""
    known = rows.groupBy(*keys).agg(
        F.count("*").alias("_sequences"), F.sum(turns).alias("_turns"), F.sum("_n").alias("_convs"), F.min("_conv").alias("_least"),
        F.min("_ids").alias("_low"), F.max("_ids").alias("_high"), F.min_by("_lens", "_ids").alias("_low_lens"),
    )
    return known.withColumn("_stop", shared("_low", "_high")).drop("_low", "_high")


def trie_nodes(convs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row for each node of the trie of ``_conv, _ids, _lens``, ``NODES`` without the first two columns.

    An empty table gives no rows, not even the root. A round costs one pass over what isn't local yet, and there are at
    most as many as places at which buckets beyond ``local_turns`` part.
    """
    rows = written(distinct_sequences(convs), "sequences").withColumn("_bucket", F.lit(""))
    head = written(_about(rows, ["_bucket"], F.size("_ids")), "trie-root")
    head = head.select("_bucket", F.array("_bucket").alias("_line"), F.lit(0).alias("_start"), F.col("_stop").alias("_end"), "_convs", "_least", F.lit(None).cast("long").alias("_above"), "_low_lens", F.lit(None).cast("string").alias("_parent"))
    heads, local, stopped = [], [], []
    while True:
        heads.append(head)
        here = rows.join(head.select("_bucket", "_end", F.col("_least").alias("_head_conv")), "_bucket")
        stopped.append(here.where(F.size("_ids") == F.col("_end")).select("_bucket", "_ends"))
        going = here.where(F.size("_ids") > F.col("_end")).withColumn("_digit", F.get("_ids", F.col("_end")))
        children = _about(going, ["_bucket", "_digit"], F.size("_ids") - F.col("_end")).withColumn("_big", (F.col("_sequences") > 1) & (F.col("_turns") > local_turns))
        children = written(children, "trie-children")
        dealt = written(going.join(children.select("_bucket", "_digit", "_big"), ["_bucket", "_digit"]), "trie-dealt")
        local.append(dealt.where(~F.col("_big")).drop("_big"))
        big = children.where("_big")
        if big.isEmpty():
            break
        path = F.concat_ws("/", "_bucket", F.col("_digit").cast("string"))
        above = head.select("_bucket", "_line", F.col("_end").alias("_head_end"), F.col("_least").alias("_above"))
        head = written(
            big.join(above, "_bucket").select(
                path.alias("_bucket"), F.concat("_line", F.array(path)).alias("_line"), (F.col("_head_end") + 1).alias("_start"), F.col("_stop").alias("_end"), "_convs", "_least", "_above", "_low_lens", F.col("_bucket").alias("_parent")
            ),
            "trie-heads",
        )
        rows = dealt.where("_big").withColumn("_bucket", path).select("_ids", "_lens", "_n", "_conv", "_ends", "_bucket")

    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    heads, stopped = union(heads), union(stopped)
    below = written(union(local).groupBy("_bucket", "_digit").applyInArrow(_local, NODES), "trie-local")

    # nodes of a head: depths _start to _end, of the same conversations; sums come from local buckets and heads below
    own = F.when(F.col("depth") > 0, (F.col("_convs") - 1) * F.get("_low_lens", F.col("depth") - 1)).otherwise(F.lit(0)).cast("long")
    chain = heads.withColumn("depth", F.explode(F.sequence("_start", "_end"))).withColumn("_own", own).drop("_low_lens")
    tops = below.where("_top").groupBy("_bucket").agg(F.count("*").alias("_kids"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
    chains = chain.where(F.col("_parent").isNotNull()).groupBy(F.col("_parent").alias("_bucket"), F.col("_bucket").alias("_child")).agg(F.sum("_own").alias("_saved"))
    chains = chains.groupBy("_bucket").agg(F.count("*").alias("_kids"), F.lit(0).cast("long").alias("_leaves"), F.sum("_saved").alias("_saved"))
    given = tops.unionByName(chains).join(heads.select("_bucket", "_line"), "_bucket").withColumn("_to", F.explode("_line"))
    given = given.groupBy(F.col("_to").alias("_bucket")).agg(F.sum(F.when(F.col("_to") == F.col("_bucket"), F.col("_kids")).otherwise(0)).alias("_kids"), F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))
    full = chain.join(given, "_bucket", "left").join(stopped, "_bucket", "left").na.fill(0, ["_kids", "_leaves", "_saved"])
    last = F.col("depth") == F.col("_end")
    after = F.sum("_own").over(Window.partitionBy("_bucket").orderBy(F.desc("depth")))
    above = full.select(
        F.col("_least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("_start"), F.col("_above")).otherwise(F.col("_least")).alias("parent_conv_id"), F.col("_convs").alias("n_convs"),
        F.when(last, F.col("_kids")).otherwise(1).cast("long").alias("n_children"), F.greatest(F.lit(1), "_leaves").cast("long").alias("n_leaves"), (F.col("_saved") + after).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("_ends", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return above.unionByName(below.drop("_bucket", "_top"))


def conversation_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The query's nodes, of rebuilt conversations.

    Null role and text are empty; rows without ``conv_id`` belong to no conversation and make no node; turns that tie
    stand by role, then text, and repeated rows are turns of their own. Columns besides the four are not looked at.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_turn"), plain("role").alias("_role"), plain("text").alias("_text"))
    return trie_nodes(rebuilt(written(sequences_of_turns(turns), "conversations")), local_turns)
