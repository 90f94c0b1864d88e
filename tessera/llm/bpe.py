"""BPE encoding and decoding with a pair occurrence index (operator 4), and token ids by library (operator 1).

Texts are cut into words as the vocabulary's normaliser and splitting pattern do; a word always gets the same ids,
so each task encodes each distinct word once and keeps a bounded table of them. Texts of ASCII and precomposed
Latin letters are cut by one expression with the same result; any others go through the library's normaliser and
pattern.

Edge cases: null or empty text has no ids and decodes to the empty string; the strings of special tokens in a
text become their ids, as in the library; repeated rows give repeated results; an empty table gives an empty
table; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path, with_text

#: Distinct words that a task keeps; then the table starts afresh. Bounds memory, never results.
KEPT_WORDS = 400_000
#: Characters that normalising leaves alone but for case, and the splitting pattern over their lower case.
_PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")

_loaded: dict[str, object] = {}


class PairIndexBPE:
    """Encodes a partition's distinct words together.

    Every adjacent pair of symbols is listed with all its positions. The active pair of the lowest rank is
    applied at all of its positions, and only the lists of the neighbouring pairs change. No rank below the
    current one can appear, so each word sees its merges in ascending rank.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = dict(spec["model"]["vocab"])
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in {**self.vocab, **self.special}.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            self.merge[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.by_rank = {rank: (pair, new) for pair, (rank, new) in self.merge.items()}
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def encode_words(self, words: list[str]) -> list[bytes]:
        vocab, merge = self.vocab, self.merge
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym += [vocab[c] for c in w[:-1]]
            sym.append(vocab[w[-1] + self.suffix])
            sym.append(-1)  # no pair reaches past it
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (sym[i], sym[i + 1])
            if pair in merge:
                at.setdefault(pair, []).append(i)
        active = [merge[p][0] for p in at]
        heapq.heapify(active)
        while active:
            pair, new = self.by_rank[heapq.heappop(active)]
            left, right = pair
            for i in sorted(at.pop(pair, ())):
                if sym[i] != left or sym[j := after[i]] != right:
                    continue  # an overlapping occurrence was merged first
                sym[i], sym[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                h = before[i]
                for p, where in (((sym[h], new), h) if h >= 0 else (None, 0), ((new, sym[k]), i)):
                    if p in merge:
                        if p not in at:
                            at[p] = []
                            heapq.heappush(active, merge[p][0])
                        at[p].append(where)
        out = []
        for s in starts:
            ids = []
            while sym[s] != -1:
                ids.append(sym[s])
                s = after[s]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def words(self, text: str) -> list[str] | None:
        """The words of a text, or None if the plain expression does not cover it."""
        if "<|" in text or not (text.isascii() or _PLAIN.search(text) is None):
            return None
        return _WORDS.findall(text.lower())

    def encode_other(self, text: str) -> bytes:
        """Ids of any text, by the library's normaliser and pattern; special tokens' strings become their ids."""
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += self.encode_words([w for w, _ in self.split(self.normalise(part)) if w])
        return b"".join(out)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next code point from 256."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


_ALPHABET = byte_alphabet()


def in_byte_alphabet(word: str) -> str:
    return word if word.isascii() and word.isprintable() else "".join([_ALPHABET[b] for b in word.encode()])


class LibraryWords(PairIndexBPE):
    """The same, with each word encoded by the tokenizers library's own model."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model

    def encode_words(self, words: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        return [struct.pack(f"<{len(t)}I", *[x.id for x in t]) for t in map(tokenize, words)]


class Words:
    """Ids of whole texts, as little-endian 32-bit bytes, from a bounded table of distinct words."""

    def __init__(self, kind: type, path: str):
        key = f"{kind.__name__} {path}"
        if key not in _loaded:
            _loaded[key] = (kind(path), {})
        self.encoder, self.kept = _loaded[key]

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        found = [self.encoder.words(t) for t in texts]
        have = set().union(*(w for w in found if w is not None))
        new = list(have - self.kept.keys())
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = list(have)
        self.kept.update(zip(new, self.encoder.encode_words([in_byte_alphabet(w) for w in new]), strict=True))
        get = self.kept.__getitem__
        for text, words in zip(texts, found, strict=True):
            yield self.encoder.encode_other(text) if words is None else b"".join(map(get, words))


def in_groups(ids: list, texts: list, most: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """Rows of a batch in groups of at most so many characters, or one row."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode whole texts: (id, n_tokens, ids, decoded), or with digests=True the SHA-256 of both.

    Every task holds the vocabulary, one Arrow batch and KEPT_WORDS distinct words. No shuffle.
    """
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Words(PairIndexBPE, path)
        token = coder.encoder.token
        for batch in batches:
            for ids, texts in in_groups(batch.column(0), batch.column(1).to_pylist()):
                counts, first, second = [], [], []
                for raw in coder.texts(texts):
                    coded = np.frombuffer(raw, "<u4")
                    decoded = " ".join(map(token.__getitem__, coded.tolist()))
                    counts.append(len(coded))
                    first.append(hashlib.sha256(raw).hexdigest() if digests else coded.astype("i4"))
                    second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
                names = ["id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"]
                types = [pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip((counts, first, second), types, strict=True))], names)

    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text")).mapInArrow(encode, f"id {kind}, n_tokens long, {last}")
    return out.withColumnRenamed("id", id_col)
