"""Token ids in files: each document is a frame of its own, compressed with a Zstandard dictionary that all share.

A folder of token files has three tables that Spark writes and commits:

* ``dictionary``: one row with the dictionary's SHA-256, its bytes and the bytes of an id (2 where the vocabulary allows it);
* ``blocks``: rows of about a megabyte in ascending order (``shard``, ``block``) with the dictionary's hash, the number of
  ids that the shard has before, and an index: the documents' ids, their numbers of token ids and the offsets of their
  frames in ``data``;
* ``shards``: for each shard the number of ids in all shards before.

One document is read by a scan of the blocks' first and last ids (row groups without it are skipped) and by one frame.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakegraph.llm.common import SLICE, scratch_root, written

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: The dictionary is trained on so many documents of the least hashes, on their first characters, by one task.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 4096, 32_768
LEVEL = 3
#: Bytes of frames, and documents, after which a block ends.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 16_384
#: Pre-tokens that a worker remembers, of at most so many characters.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Bytes of text that are encoded together (one text may have more), and new chunks that are given to the library as one text.
TOGETHER, LEARNED = 12 << 20, 5000

#: Texts with other characters than these, and those with a space before white space or at the end, go to the library whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏªµº"
UNUSUAL = f"[^{LETTERS}\t\n\r -~¡-©«¬®-±´¶-¸»¿×÷]| ([ \t\n\r]|$)"
#: The byte-level pre-token pattern, for those characters and a chunk whose white space stands alone or last.
PIECE = f"('(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^ \t\n\r0-9{LETTERS}]+| ?[\t\n\r]+| )"


class Encoder:
    """Ids of texts, as the library gives them without added special tokens.

    The byte-level pattern parts a text before each single space that a word follows. So a text is cut there, each distinct
    chunk is put together once from its pre-tokens, and each distinct pre-token is encoded once: many new ones as one
    text, in which the bytes of the tokens tell where they end.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(config)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory: dict[str, bytes] = {}
        # cutting is right for the byte level's own pattern without normaliser; else every text goes to the library whole
        split = self.tokenizer.pre_tokenizer
        same = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        self.plain = same and self.tokenizer.normalizer is None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([UNUSUAL, *added])
        #: Bytes that each token stands for; an added token's are never asked for.
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.token_bytes[i] = len(token)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each with a space in front."""
        ids = np.frombuffer(self.library([" " + " ".join(chunks)])[0], self.kind)
        ends, wanted = np.cumsum(self.token_bytes[ids]), np.cumsum([1 + len(c.encode()) for c in chunks])
        cut = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or not (ends[cut] == wanted).all():
            return self.library([f" {c}" for c in chunks])
        raw, at = ids.tobytes(), ((cut + 1) * self.kind.itemsize).tolist()
        return list(map(raw.__getitem__, map(slice, [0, *at[:-1]], at)))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, from memory or the library; new ones with a space in front go there as one text."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        found = list(map(self.memory.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        words = [k for k in new if pieces[k][:1] == " " and not pieces[k].isspace()]
        for at in range(0, len(words), LEARNED):
            some = words[at : at + LEARNED]
            for k, x in zip(some, self.spaced([pieces[k][1:] for k in some]), strict=True):
                found[k] = x
        rest = [k for k in new if found[k] is None]
        for k, x in zip(rest, self.library([pieces[k] for k in rest]), strict=True):
            found[k] = x
        self.memory.update((pieces[k], found[k]) for k in new if len(pieces[k]) <= REMEMBERED_CHARS)
        return found

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks with a space in front, one after the other, and the number of each."""
        spaced = pc.binary_join_element_wise("", chunks, " ")
        odd = pc.match_substring_regex(chunks, "[\t\n\r]{2}[^\t\n\r]").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring_regex(spaced, PIECE, "\\1\0"), "\0")
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        coded = split.flatten().dictionary_encode()
        ids, size = _gathered(self._pieces(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64), self.kind)
        sizes = np.diff(np.cumsum(size)[ends - 1], prepend=0)
        if odd.any():  # white space that parts within a chunk
            raw, cut = ids.tobytes(), (np.concatenate([[0], np.cumsum(sizes)]) * self.kind.itemsize).tolist()
            parts = [raw[a:b] for a, b in zip(cut, cut[1:])]
            at = np.flatnonzero(odd).tolist()
            for k, x in zip(at, self.library(spaced.take(pa.array(at)).to_pylist()), strict=True):
                parts[k] = x
            ids, sizes = np.frombuffer(b"".join(parts), self.kind), np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        return ids, sizes

    def encode(self, texts: pa.Array) -> list[bytes]:
        """From an array of strings without nulls."""
        size = np.cumsum(pc.binary_length(texts).to_numpy()) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        return [x for a, b in zip(cuts, cuts[1:]) if b > a for x in self._encode(texts.slice(a, b - a))]

    def _encode(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(texts), bool)
        whole = iter(self.library(texts.filter(pa.array(odd)).to_pylist()))
        plain = texts.filter(pa.array(~odd))
        if not len(plain):
            return list(whole)
        split = pc.split_pattern(plain, " ")
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        # a text's first chunk has no space in front: these stand behind the others, one for each text
        heads = self.library(coded.dictionary.take(pa.array(code[first[:-1]])).to_pylist())
        ids, sizes = self._chunks(coded.dictionary)
        code[first[:-1]] = len(sizes) + np.arange(len(plain))
        sizes = np.concatenate([sizes, np.fromiter(map(len, heads), np.int64, len(heads)) // self.kind.itemsize])
        flat, size = _taken(np.concatenate([ids, np.frombuffer(b"".join(heads), self.kind)]), sizes, code)
        raw, cut = flat.tobytes(), (np.concatenate([[0], np.cumsum(size)])[first] * self.kind.itemsize).tolist()
        made = iter([raw[a:b] for a, b in zip(cut, cut[1:])])
        return [next(whole) if o else next(made) for o in odd.tolist()]


def _taken(flat: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts (of ``sizes``) of ``flat`` that ``code`` names, one after the other, and their sizes."""
    starts, size = np.cumsum(sizes) - sizes, sizes[code]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


def _gathered(parts: list[bytes], code: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return _taken(np.frombuffer(b"".join(parts), kind), np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize, code)


_ENCODERS: dict[str, Encoder] = {}


def encoder(token: str, config: str) -> Encoder:
    """This worker's encoder; of one vocabulary at a time."""
    if token not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[token] = Encoder(config)
    return _ENCODERS[token]


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    joined = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, len(joined) // 4), samples, k=200, d=8).as_bytes() if len(samples) > 8 else joined[:size]
    except zstandard.ZstdError:
        return joined[:size]


def _dictionary(content: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(content)} if len(content) >= 8 else {}


def _sampled(docs: DataFrame) -> DataFrame:
    """The documents whose hash of id and text is least; the bar leaves about four times as many rows to sort."""
    some = docs.where(F.length("_text") > 0).select("_text", F.xxhash64("_id", "_text").alias("_hash"))
    bar = min(1.0, 4 * SAMPLE_ROWS / max(1, docs.count()))
    some = some.where(F.col("_hash") <= F.lit(min(2**63 - 1, int(2**64 * bar) - 2**63)))
    return some.select(F.substring("_text", 1, SAMPLE_CHARS).alias("_text"), "_hash").orderBy("_hash", "_text").limit(SAMPLE_ROWS).coalesce(1)


BLOCKS = "shard int, block int, dictionary string, first_id long, last_id long, n_docs long, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, offsets array<long>, data binary"


def write_tokens(docs: DataFrame, path: str, config: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of every text to ``path`` in ascending order of ``id_col`` (whole numbers), each followed by ``end_id``.

    Null ids come first, null texts are empty. Rows with the same id stand in the order of their number of ids, their
    frames' hashes and their frames, so that every run writes the same. Further columns are not kept. An empty table has a dictionary of no bytes
    and no blocks. The texts are encoded once, and frames, not texts, are sorted.
    """
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(config)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(token, shared.value)
        samples = [x for b in batches for x in enc.encode(b.column("_text"))]
        content = train(samples)
        yield pa.RecordBatch.from_pydict({"sha256": [hashlib.sha256(content).hexdigest()], "content": pa.array([content], pa.binary()), "id_bytes": pa.array([enc.kind.itemsize], pa.int32())})

    samples = _sampled(docs)
    if samples.isEmpty():
        none = [(hashlib.sha256(b"").hexdigest(), b"", 2)]
        made = docs.sparkSession.createDataFrame(none, "sha256 string, content binary, id_bytes int")
    else:
        made = samples.mapInArrow(learned, "sha256 string, content binary, id_bytes int")
    made.write.parquet(f"{path}/dictionary")
    sha, content, _ = read_dictionary(docs.sparkSession, path)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(token, shared.value)
        pack = zstandard.ZstdCompressor(level=LEVEL, **_dictionary(content))
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            ids = [x + end for x in enc.encode(batch.column("_text"))]
            n = [len(x) // enc.kind.itemsize for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(map(pack.compress, ids), pa.binary())], names=["_id", "_n", "_frame"])

    laid = written(docs.select("_id", "_text").mapInArrow(frames, "_id long, _n long, _frame binary"), "frames")
    # ranges are cut by a hash of the frame, so that no frame is sampled to the driver
    blocks = laid.withColumn("_hash", F.xxhash64("_frame")).repartitionByRange("_id", "_n", "_hash").sortWithinPartitions("_id", "_n", "_hash", "_frame").drop("_hash").mapInArrow(_packer(sha), BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def _packer(sha: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, tokens, frames, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            values = [shard, block, sha, min(known, default=None), max(known, default=None), len(ids), before, sum(tokens), ids, tokens, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("_id", "_n", "_frame")), strict=True):
                ids.append(i)
                tokens.append(n)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield row()
                    block, before = block + 1, before + sum(tokens)
                    ids, tokens, frames, size = [], [], [], 0
        if ids:
            yield row()

    return pack


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").head()
    content = bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != row["sha256"]:
        raise ValueError(f"{path}: the dictionary isn't the one that its hash names")
    return row["sha256"], content, row["id_bytes"]


def read_documents(spark: SparkSession, path: str, schema: str, fn: Callable[[np.ndarray], tuple], only: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens`` and the columns of ``schema``, which ``fn`` makes from a document's ids; all documents or ``only`` some.

    ``start`` is the number of ids of all documents before. With ``only``, blocks whose range of ids has none of them are
    skipped in the scan, and of the others just the frames asked for are read.
    """
    sha, content, id_bytes = read_dictionary(spark, path)
    wanted = None if only is None else frozenset(only)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(near)
    starts = spark.read.schema("shard int, n_docs long, n_tokens long, start long").parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    blocks = blocks.join(starts, "shard").select("dictionary", (F.col("shard_start") + F.col("before")).alias("at"), "doc_ids", "doc_tokens", "offsets", "data")
    out = StructType([*StructType.fromDDL("doc_id long, start long, n_tokens long"), *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor(**_dictionary(content))
        for batch in batches:
            for k in range(batch.num_rows):
                block = {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "data"}
                if block["dictionary"] != sha:
                    raise ValueError(f"{path}: a block was written with another dictionary")
                data, at, rows = memoryview(batch.column("data")[k].as_buffer()), block["at"], []
                for i, n, a, b in zip(block["doc_ids"], block["doc_tokens"], block["offsets"][:-1], block["offsets"][1:], strict=True):
                    if wanted is None or i in wanted:
                        ids = np.frombuffer(unzip.decompress(data[a:b]), f"<u{id_bytes}")
                        if len(ids) != n:
                            raise ValueError(f"{path}: document {i} has {len(ids)} ids, not {n}")
                        rows.append((i, at, n, *fn(ids)))
                    at += n
                for first in range(0, len(rows), SLICE):
                    columns = zip(*rows[first : first + SLICE], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return blocks.mapInArrow(unpack, out)


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``."""
    return read_documents(spark, path, "ids array<int>", lambda ids: (ids.astype(np.int32),), only)


def document_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's digest of what is read back from files in the shared folder."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        config = f.read()
    spark = docs.sparkSession
    folder = f"{scratch_root(spark)}/llm/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, folder, config)
    return read_documents(spark, folder, "ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))
