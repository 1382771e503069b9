"""BPE encoding by forced-boundary splitting, and decoding.

A pair of neighbouring symbols that no vocabulary entry holds inside can never be joined by a
merge: every merge result is a vocabulary entry. Between two such symbols there is a certain
cut. A word is split there, its fragments are encoded independently, and their ids are
concatenated. The fragments go through the library's BPE model; words, fragments and cuts are
worked out here and remembered in bounded caches, since words repeat.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellframe.llm.shared import append_columns

#: White space as the tokenizer file's pattern ``\s`` has it; str.split() adds \x1c-\x1f.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries in each half of a cache: memory per worker stays bounded, whatever the text.
CACHE = 300_000
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class ForcedBoundaryBpe:
    """Encoder for a word-end BPE tokenizer file (NFC, lower case, white space dropped)."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        self.final = BPE(vocab, merges, end_of_word_suffix=END)
        # ids above the vocabulary are the special tokens
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        # the same merges for fragments that do not end a word: their last symbol is a plain one
        self.inner = BPE(vocab, merges)
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbol = byte_symbols()
        of = {c: b for b, c in enumerate(self.symbol)}
        joined, joined_end = bytearray(65536), bytearray(65536)
        for token in vocab:
            ends = token.endswith(END)
            body = [of[c] for c in (token[: -len(END)] if ends else token)]
            for i in range(1, len(body)):
                pair = body[i - 1] << 8 | body[i]
                (joined_end if ends and i == len(body) - 1 else joined)[pair] = 1
        self.joined_end = bytes(joined_end)
        # for each first symbol, a table of the second ones that are never joined to it
        self.apart = [bytes(1 - x for x in joined[r << 8 : r + 1 << 8]) for r in range(256)]
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        # ids by stretch of text; two generations: what a whole generation does not ask for is forgotten
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cuts(self, word: bytes) -> list[int]:
        """Offsets inside a word where no vocabulary entry can span."""
        out, apart, row, last = [], self.apart, self.apart[word[0]], len(word) - 1
        for i, b in enumerate(word[1:last], 1):
            if row[b]:
                out.append(i)
            row = apart[b]
        if last and not self.joined_end[word[-2] << 8 | word[-1]]:
            out.append(last)
        return out

    def piece(self, piece: str) -> bytes:
        found = self.recall(piece)
        if found is None:
            word = piece.encode()
            symbols = piece if len(word) == len(piece) and piece.isalpha() else "".join([self.symbol[b] for b in word])
            ids, at = [], 0
            for to in self.cuts(word):
                ids += [t.id for t in self.inner.tokenize(symbols[at:to])]
                at = to
            ids += [t.id for t in self.final.tokenize(symbols[at:])]
            found = array("i", ids).tobytes()
            self.keep(piece, found)
        return found

    def recall(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, ids: bytes) -> None:
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[key] = ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of text without white space."""
        found = self.recall(chunk)
        if found is None:
            if self.special_pattern is not None and "<" in chunk and self.special_pattern.search(chunk):
                parts = [p for p in self.special_pattern.split(chunk) if p]
                found = b"".join([array("i", [self.special[p]]).tobytes() if p in self.special else self.plain(p) for p in parts])
            else:
                found = self.plain(chunk)
            self.keep(chunk, found)
        return found

    def plain(self, chunk: str) -> bytes:
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return self.piece(chunk)
        else:
            # each character is lowered alone: str.lower() would look at a sigma's neighbours
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = "".join([c.lower() for c in chunk]) if "Σ" in chunk else chunk.lower()
        return b"".join([self.piece(p) for p in self.pieces.findall(chunk)])

    def split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in regex.split(f"[{SPACE}]+", text) if c]
        return text.split()

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        chunks = self.split(text)
        found = list(map(self.young.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.chunk(chunks[i])
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)

    def decode(self, ids) -> str:
        """The library's decoding of a file without a decoder: tokens joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


_encoders: dict[str, ForcedBoundaryBpe] = {}


def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder a worker process: tables and caches outlive a task."""
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryBpe(path)
    return _encoders[path]


def encode_and_decode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = "decoded"
) -> DataFrame:
    """``docs`` with its texts' token ids and, unless None, what these ids decode to.

    Null and empty texts have no ids and decode to the empty text. Rows pass through one by
    one: repeated rows, ties and other columns stay as they are; a column that already has
    one of the new names is replaced. Work is a map over partitions, without a shuffle.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def compute():
        e = encoder(path)

        def of(batch):
            each = [e.packed(x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in each], out=ends[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(each))])
            kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
            made = [pa.Array.from_buffers(kind, len(each), [None, pa.py_buffer(ends)], children=[flat])]
            return made + [[e.decode(np.frombuffer(x, np.int32).tolist()) for x in each]] * bool(decoded)

        return of

    return append_columns(docs, fields, compute)
