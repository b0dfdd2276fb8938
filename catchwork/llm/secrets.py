"""Secret scans by grammar inference.

Base rules find assignments to secret names, access keys and long hexadecimal runs. Their values are the labelled
credentials: for each kind a prefix tree over character classes is built from a bounded sample, and
states whose continuations are statistically compatible (Hoeffding bound) are merged, red-blue order, into a
probabilistic automaton. Every other run of the value's characters, as long as the shortest value that the rules label
(``SHORTEST``) or longer, is a candidate; its format likelihood is the mean log probability of its symbols in an
automaton. It is a secret where some automaton finds it as likely as all but the least likely ``DOUBT`` of its labelled
values, and likelier than the chain of neighbouring classes over all runs of all texts, which is what plain words and numbers follow.
Base spans always stay.

The texts are read twice: for the labelled values and the chain, then for the spans. The fit sample has at most ``FIT_VALUES``
distinct values a kind, the smallest by hash, up to ``FIT_CHARS`` characters in all; candidates and base spans cover all texts whole.

Cases: null text is empty. Empty tables and corpora without labelled values have base spans only. Repeated rows give
repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import checkpointed
from .arrow import steps, utf8

KINDS = ["assign", "access", "hex", "format"]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = 8
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
FIT_VALUES = 500
FIT_CHARS = 100_000
ALPHA = 0.05
DOUBT = 0.02
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def _runs(chars: str) -> bytes:
    return bytes(120 if chr(b) in chars else 32 for b in range(256))


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX_RUN = _runs(_DIGITS + "abcdef")
#: Character classes: digit, hexadecimal letter, other letter, by case; punctuation stands for itself, the blank for all else.
CLASSES = " 0agAG+/_.=-"
_SYMBOLS = "".join("0" if c in _DIGITS else "a" if c in "abcdef" else "g" if c in _LOWER else "A" if c in "ABCDEF" else "G" if c in _UPPER else c if c in CLASSES else " " for c in map(chr, range(256))).encode("latin-1")
_PLACES = bytes(CLASSES.index(chr(c)) for c in _SYMBOLS)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[str, str]]]:
    """(start, end, kind) of the base rules, and the labelled (kind, value)."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 8:
            spans.append((*m.span(), "assign"))
            values.append(("assign", m[1]))
    for kind, rule, least in (("access", ACCESS, 16), ("hex", HEX, 32)):
        for m in rule.finditer(text):
            if m.end() - m.start() >= least:
                spans.append((*m.span(), kind))
                values.append((kind, m[0]))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))), values


def candidates(text: bytes, taken: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, value) in bytes of the runs that none of the sorted spans overlaps."""
    out, k, reach = [], 0, -1
    for m in RUN.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            out.append((*m.span(), m[0]))
    return out


def _named(text: bytes) -> bool:
    """Whether the text may hold a base match."""
    low = text.lower()
    return b"AKIA" in text or any(n in low for n in _NAMES) or b"x" * 32 in text.translate(_HEX_RUN)


def symbols(value: bytes) -> str:
    return value.translate(_SYMBOLS).decode("latin-1")


class Chain:
    """Log probabilities of neighbouring character classes over all runs; a run is between blanks."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(len(CLASSES), len(CLASSES)).astype(float)
        counts[0, 0] = 0  # between two runs
        self.logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
        self.logs[0, 0] = 0.0

    def score(self, value: bytes) -> float:
        """Mean log probability a symbol, the end included."""
        x = np.frombuffer(b" " + value + b" ", np.uint8)
        x = np.frombuffer(_PLACES, np.uint8)[x]
        return float(self.logs[x[:-1], x[1:]].sum() / (len(value) + 1))


def scan(docs: DataFrame) -> tuple[DataFrame, Chain]:
    """The distinct labelled (kind, value) of all texts, and the chain of classes over all their runs; the texts are read once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(len(CLASSES) ** 2, np.int64)
        for batch in steps(batches, "text"):
            values: set[tuple[str, str]] = set()
            for t in utf8(batch.column("text")):
                x = np.frombuffer((b" " + t + b" ").translate(_PLACES), np.uint8).astype(np.int16)
                pairs += np.bincount(x[:-1] * len(CLASSES) + x[1:], minlength=len(pairs))
                if _named(t):
                    values.update(base_spans(t.decode())[1])
            if values:
                kinds, found = zip(*values, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(found), pa.array([0] * len(kinds))], names=["kind", "value", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(pairs)), pa.array([str(k) for k in range(len(pairs))]), pa.array(pairs)], names=["kind", "value", "n"])

    rows = docs.selectExpr("cast(text as string) text").mapInArrow(kernel, "kind string, value string, n bigint")
    held = checkpointed(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    counts = np.zeros(len(CLASSES) ** 2, np.int64)
    for r in held.where("kind = ''").collect():
        counts[int(r["value"])] = r["n"]
    return held.where("kind <> ''").select("kind", "value"), Chain(counts)


class Automaton:
    """A probabilistic automaton inferred from values by merging compatible prefix-tree states."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.ends: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for v in values:
            self._add(symbols(v.encode()))
        self._merge_all()
        scores = sorted(self.score(v.encode()) for v in values)
        self.least = scores[int(DOUBT * len(scores))] if scores else math.inf

    def _add(self, word: str) -> None:
        q = 0
        for c in word:
            self.count[q][c] = self.count[q].get(c, 0) + 1
            if c not in self.next[q]:
                self.next[q][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.ends.append(0)
            q = self.next[q][c]
        self.ends[q] += 1

    def _visits(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, q: int, r: int) -> bool:
        todo, seen = [(q, r)], {(q, r)}
        while todo:
            a, b = todo.pop()
            n, m = self._visits(a), self._visits(b)
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
            more = {(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a] and self.next[b][c] != self.next[a][c]} - seen
            todo += more
            seen |= more
        return True

    def _fold(self, q: int, r: int) -> None:
        todo = [(q, r)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red = [0]
        parents = {r: (0, c) for c, r in self.next[0].items()}
        while parents:
            blue = max(parents, key=lambda q: (self._visits(q), -q))
            at, c = parents.pop(blue)
            for r in red:
                if self._compatible(r, blue):
                    self.next[at][c] = r
                    self._fold(r, blue)
                    break
            else:
                red.append(blue)
            known = set(red)
            parents = {r: (q, c) for q in red for c, r in self.next[q].items() if r not in known}
        self.states = len(red)

    def score(self, value: bytes) -> float:
        """Mean log probability a symbol, the end included; a step that the automaton lacks is impossible."""
        q, total, word = 0, 0.0, symbols(value)
        for c in word:
            n = self._visits(q)
            if c not in self.next[q]:
                return -math.inf
            total += math.log((self.count[q][c] + 0.5) / (n + 1))
            q = self.next[q][c]
        total += math.log((self.ends[q] + 0.5) / (self._visits(q) + 1))
        return total / (len(word) + 1)


def fit(values: DataFrame) -> dict[str, Automaton]:
    """An automaton for each kind of the distinct labelled (kind, value)."""
    out = {}
    for kind in KINDS[:3]:
        own, hashed = values.where(F.col("kind") == kind), F.xxhash64("value")
        # only about as many of the smallest hashes as are wanted are sorted, whatever the number of tasks
        share = min(1.0, 4 * FIT_VALUES / max(1, own.count()))
        some = own.where(hashed <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).select("value", hashed.alias("h"), F.length("value").alias("size"))
        # a value longer than the whole sample may be never gets to the driver
        rows = some.where(F.col("size") <= FIT_CHARS).orderBy("h", "value").limit(FIT_VALUES).collect()
        taken, size = [], 0
        for r in rows:
            size += r["size"]
            if size <= FIT_CHARS:
                taken.append(r["value"])
        if taken:
            out[kind] = Automaton(taken)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array of start, end, kind)."""
    values, chain = scan(docs)
    models = docs.sparkSession.sparkContext.broadcast((list(fit(values).values()), chain))

    def likely(value: bytes) -> bool:
        automata, plain = models.value
        scores = [x for m in automata if (x := m.score(value)) >= m.least]
        return bool(scores) and max(scores) > plain.score(value)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            base, more = [], []
            for t in utf8(batch.column("text")):
                found = base_spans(t.decode())[0] if _named(t) else []
                # spans in characters from here on in bytes, and back, where the text is not ASCII
                at = None if t.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                begin = None if at is None else np.searchsorted(at, np.arange(at[-1] + 1) + 1) - 1
                taken = [(s, e) if begin is None else (int(begin[s]), int(begin[e])) for s, e, _ in found]
                hits = [(s, e) for s, e, v in candidates(t, taken) if likely(v)] if models.value[0] else []
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                more.append([{"start": s if at is None else int(at[s]), "end": e if at is None else int(at[e]), "kind": "format"} for s, e in hits])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPAN), pa.array(more, _SPAN)], names=["doc_id", "base", "more"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    scored = docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(kernel, f"doc_id {kind}, base {span}, more {span}")
    rank = F.array(*[F.lit(k) for k in KINDS])

    def text(column: str) -> Column:
        ordered = F.array_sort(F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    every = scored.withColumn("found", F.concat("base", "more"))
    return every.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"), "found")
