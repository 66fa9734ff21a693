"""Token counts with a whole-token shortcut.

Before the job, the vocabulary's own strings are tried in the library: those that the pre-tokenizer leaves whole and that
encode as one token count as one wherever they stand as a pre-token. Only the other pre-tokens are merged, and results
are remembered within a bound. Texts with characters whose normalisation is not plain lower-casing go to the library as
a whole.
"""

from __future__ import annotations

import json
import re
import uuid

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import map_texts, set_aside

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
#: Beyond printable ASCII, tab and line ends, and Latin letters up to U+024F (but U+0130), a text goes to the library whole.
UNUSUAL = re.compile("[^\t\n\r -~¡-įı-ɏ]|<\\|")
#: Entries of each worker's memory for the counts of white-space separated chunks.
REMEMBERED = 300_000


def word_pattern(config: str) -> regex.Pattern:
    """The pre-token pattern of a tokenizer's json.

    The shortcut needs what it was proved for: byte-pair merges with word ends, lower-casing at most as normaliser, and one
    pattern that splits before the byte level. Anything else is refused, so that no count is silently wrong.
    """
    spec = json.loads(config)
    model, normal, split = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = sorted(x["type"] for x in normal.get("normalizers", [normal]) if x)
    parts = split.get("pretokenizers", [split])
    patterns = [p["pattern"]["Regex"] for p in parts if p.get("type") == "Split" and "Regex" in p.get("pattern", {})]
    fits = model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") == "</w>" and "Lowercase" in kinds and set(kinds) <= {"NFC", "Lowercase", "Replace"} and split.get("type") == "Sequence"
    if not fits or len(patterns) != 1 or {p.get("type") for p in parts} - {"Split", "ByteLevel"}:
        raise ValueError("token counts: this kind of tokenizer file isn't supported")
    return regex.compile(patterns[0])


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(tokenizer, pattern: regex.Pattern) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    alphabet, found = byte_alphabet(), set()
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        if piece.endswith("</w>") and all(c in alphabet for c in piece[:-4]):
            try:
                text = bytes(alphabet[c] for c in piece[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if text and not UNUSUAL.search(text) and text == text.lower() and pattern.findall(text) == [text]:
                found.add(text)
    texts = sorted(found)
    return [t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]


class Counter:
    def __init__(self, tokenizer, whole: list[str], pattern: regex.Pattern):
        self.tokenizer, self.whole, self.pattern = tokenizer, frozenset(whole), pattern
        self.memory: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def chunk(self, chunk: str) -> int:
        whole = self.whole
        return sum(1 if p in whole else self.merge(p) for p in self.pattern.findall(chunk))

    def count(self, text: str) -> int:
        if UNUSUAL.search(text):
            return self.merge(text)
        memory, chunks = self.memory, text.lower().split()
        try:
            return sum(map(memory.__getitem__, chunks))
        except KeyError:
            total = 0
            for c in chunks:
                n = memory.get(c)
                if n is None:
                    n = self.chunk(c)
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    if len(c) < 64:
                        memory[c] = n
                total += n
            return total


_COUNTERS: dict[str, Counter] = {}


OUT = "_n_bytes long, _n_tokens long"


def count_tokens(df: DataFrame, text: str, path: str) -> DataFrame:
    """Replaces ``text`` by ``_n_bytes`` and ``_n_tokens``, as the library counts them without added special tokens.

    Null and empty texts have no bytes and no tokens. Every text counts whole, however long; repeated rows count alike; an
    empty table stays empty. A caller's column with an output column's name goes on under its name and ``_given``.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        config = f.read()
    whole = prove_whole_tokens(Tokenizer.from_str(config), word_pattern(config))
    shared, token = df.sparkSession.sparkContext.broadcast((config, whole)), uuid.uuid4().hex

    def make(texts: list[bytes | None]) -> dict[str, list]:
        if token not in _COUNTERS:
            config, whole = shared.value
            _COUNTERS.clear()
            _COUNTERS[token] = Counter(Tokenizer.from_str(config), whole, word_pattern(config))
        counter = _COUNTERS[token]
        return {"_n_bytes": [len(t or b"") for t in texts], "_n_tokens": [counter.count(t.decode()) if t else 0 for t in texts]}

    return map_texts(set_aside(df, OUT), text, OUT, make)


def document_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The query's digest."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    out = count_tokens(docs.select("doc_id", F.col("text").alias("_text")), "_text", path)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > limit).alias("over_limit"))
