"""Token files: exact round trips against the library, offsets, dictionaries, single documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakegraph.llm import tokenfiles

SCHEMA = "doc_id long, text string, start int, _frame string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  x", "don't  we'll I'VE 'sing ''s", "a<|endoftext|>b <|endoftext|>", "日本語 text ２３ ½ x²", "tab\tand\r\nline\x0bfeed\x00\x1f", "é è nbsp ́combining", "¿qué? ª º µ × ÷ «x» Ǆ ǅ",
    "1234 12ab ab12 _under_ ...!!! $%^", "😀 emoji 👩‍👩‍👧 zwj", "  trailing   ", "word " * 5000, "x" * 30_000, "ſ K Å ﬁ İ ı",
]


def rows():
    rng = random.Random(4)
    words = "the naïve Über  cat's 12 won't , . ! état".split(" ")
    out = [(i, t, i, "x") for i, t in enumerate(ODD)]
    out += [(100 + i, " ".join(rng.choices(words, k=rng.randint(0, 80))), 1, "x") for i in range(300)]
    return out + [(100, "another of the same id", 1, "x"), out[3], out[3], (None, "no id", 1, "x"), (-5, "negative id", 1, "x")]


def encoded(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    got = tokenfiles.document_files(df)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted((-(10**9) if r[0] is None else r[0], len(ids), crc(ids)) for r, ids in zip(rows(), encoded([r[1] for r in rows()]), strict=True))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()), key=lambda r: r[1])
    assert sorted((-(10**9) if i is None else i, n, c) for i, _, n, c in got) == want
    order = [-(10**9) if r[0] is None else r[0] for r in got]
    assert order == sorted(order)  # null first, then ascending
    assert [s for _, s, *_ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()


def test_encoder_equals_library(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        enc = tokenfiles.Encoder(f.read())
    rng = random.Random(9)
    alphabet = "abcXYZ éßñǅ¿×'’ \t\n12.,!<|>_ab  "
    texts = [t for t in ODD if t is not None] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(4000)]
    monkeypatch.setattr(tokenfiles, "TOGETHER", 2000)
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 500)
    for text, got, ids in zip(texts, enc.encode(pa.array(texts)), encoded(texts), strict=True):
        assert np.frombuffer(got, enc.kind).tolist() + [2] == ids, text
    assert enc.encode(pa.array([], pa.string())) == [] and max(map(len, enc.memory)) <= tokenfiles.REMEMBERED_CHARS


def test_files_and_single_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", 600)
    path = str(tmp_path / "files")
    with open(PATH, encoding="utf-8") as f:
        tokenfiles.write_tokens(spark.createDataFrame(rows(), SCHEMA).repartition(3), path, f.read())
    blocks = spark.read.parquet(f"{path}/blocks")
    sha, content, id_bytes = tokenfiles.read_dictionary(spark, path)
    assert blocks.count() > 10 and {r[0] for r in blocks.select("dictionary").distinct().collect()} == {sha} and id_bytes == 2
    some = {r.doc_id: list(r.ids) for r in tokenfiles.read_tokens(spark, path, [7, 250, 13, 99_999]).collect()}
    assert some == {i: encoded([dict((r[0], r[1]) for r in rows()[:-5])[i]])[0] for i in (7, 250, 13)}
    near = blocks.where((F.col("first_id") <= 250) & (F.col("last_id") >= 250))
    assert 1 <= near.count() <= 2
    row = near.first()  # a frame alone, by the offset index, with nothing but the dictionary
    k = row.doc_ids.index(250)
    ids = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompress(bytes(row.data)[row.offsets[k] : row.offsets[k + 1]])
    assert np.frombuffer(ids, "<u2").tolist() == some[250]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(bytes(row.data)[row.offsets[k] : row.offsets[k + 1]])


def test_small_and_empty_tables(spark):
    assert tokenfiles.document_files(spark.createDataFrame([], SCHEMA)).count() == 0
    one = tokenfiles.document_files(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in one] == [(1, 0, 1, zlib.crc32(b"\x02\0\0\0"))]
