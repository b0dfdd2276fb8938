"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so every such pair in
a text is a certain cut: the fragments between cuts are encoded independently and concatenated. The
pairs are read off the vocabulary. Before that, text is cut where a space follows a non-space: there the
pre-tokenizer's pattern always begins a new match; only pairs that are forced cuts are used, so
fragments recur from text to text and their ids are kept in a bounded table.

Cases: null text is empty (no ids, empty decoded text). A special token's string in a text is that
token, as in the tokenizers library. Texts of any length are encoded whole. Repeated rows give
repeated result rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .arrow import steps, utf8

#: The byte-level pre-tokenizer's public pattern, with white space spelt out by code point.
_WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"\t-\r " + _WIDE
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WIDE_SPACE = regex.compile(rf"[{_WIDE}]")
#: Entries in a generation of the fragment table; older ones are encoded anew, which changes no result.
TABLE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Fragments(dict):
    """The ids of recurring fragments; two generations, so that frequent ones outlive the bound."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= TABLE:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for s in self.special:
            self.ids.pop(s, None)
        self.bytes: dict[int, bytes] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        inside = np.zeros(1 << 16, bool)
        for t in self.ids:
            inside[[t[k] << 8 | t[k + 1] for k in range(len(t) - 1)]] = True
        self.inside = inside.tobytes()
        blanks = [*range(9, 14), 32]
        # bytes after which a space is no certain cut, such as the last of a no-break space: a chunk goes on there
        sticky = bytes(b for b in range(256) if b not in blanks and any(inside[b << 8 | s] for s in blanks))
        self.crowded = re.compile(rb"[\t-\r %s][\n ]" % re.escape(sticky))  # white space in a row, or no certain cut before it
        goes_on = rb"(?:(?<=[%s])[\t-\r ]+[^\t-\r ]*)*" % re.escape(sticky) if sticky else b""
        self.chunk = re.compile(rb"[\t-\r ]*[^\t-\r ]+" + goes_on + rb"|[\t-\r ]+")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.order = {tuple(bytes(letters[c] for c in x) for x in m): k for k, m in enumerate(merges)}
        ranked = [self.ids.get(a + b, -1) for a, b in self.order]
        # merges in the order of their tokens' ids: the ranks alone tell the order, and a compiled merge loop applies
        self.core = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=self.ids, special_tokens={}) if ranked == sorted(ranked) and len(ranked) + 256 == len(self.ids) else None
        self.table = Fragments(self.pieces)
        self.words = Fragments(lambda w: self.pieces(w if w[:1] == b"\n" else b" " + w))

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cut at each byte pair that no token contains."""
        out, begin, inside = [], 0, self.inside
        for k in range(1, len(piece)):
            if not inside[piece[k - 1] << 8 | piece[k]]:
                out.append(piece[begin:k])
                begin = k
        return [*out, piece[begin:]] if piece else out

    def merge(self, fragment: bytes) -> list[int]:
        """Lowest merge first, leftmost among equals."""
        if fragment in self.ids:
            if self.core or len(fragment) == 1:
                return [self.ids[fragment]]
        if self.core:
            return self.core._core_bpe.encode_single_piece(fragment)
        parts = [fragment[k : k + 1] for k in range(len(fragment))]
        while len(parts) > 1:
            rank, k = min((self.order.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def pieces(self, chunk: bytes) -> bytes:
        ids = array("I")
        for piece in (chunk,) if chunk.isalpha() else [p.encode() for p in _PATTERN.findall(chunk.decode())]:
            for fragment in self.fragments(piece):
                ids.extend(self.merge(fragment))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _plain(self, text: bytes) -> bytes:
        if not text:
            return b""
        if not text.isascii() and _WIDE_SPACE.search(text.decode()):
            return self.pieces(text)
        if self.crowded.search(text):
            return b"".join(map(self.table.__getitem__, self.chunk.findall(text)))
        first, *rest = text.replace(b"\n", b" \n").split(b" ")
        return (self.pieces(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        for s, i in self.special.items():
            if s in text:
                return np.array([i], "<u4").tobytes().join(self.encode(t) for t in text.split(s))
        return self._plain(text)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        joined = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()


_CODERS: dict[int, ByteBpe] = {}


def bpe_round_trip(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids and decoded."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(spec.value)) not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = ByteBpe(spec.value)
        coder = _CODERS[key]
        for batch in steps(batches, "text"):
            ids = [coder.encode(t) for t in utf8(batch.column("text"))]
            decoded = [coder.decode(i) for i in ids]
            out = [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(t).hexdigest() for t in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                out += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary()).cast(pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(kernel, schema)
