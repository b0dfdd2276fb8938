"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark word windows.

A word is a maximal run of characters other than ASCII punctuation, space and controls, after
A-Z are lower-cased. A window is ten consecutive words of an item; an item of fewer words, but not
none, is one window. A document is scanned once; every word inside an occurrence of a window is hit.

The benchmark is a stated pattern set. It is read to the driver only in blocks whose text stays
within ``block_bytes``; one block (the usual case) is one automaton, more blocks are scanned one
after another inside the same Spark stage, without a shuffle, and their hits merged.

Cases: null or wordless text has no words and no hits. A null or wordless item has no windows; an item
with a null id marks words but cannot be listed. Repeated items count once by id. Repeated document
rows give repeated result rows. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import steps, utf8

_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STATE = "doc_id {id}, text string, n_words bigint, hits array<struct<s:int,e:int>>, items array<string>, spans array<struct<s:int,e:int>>"


def words_of(text: bytes) -> list[bytes]:
    """The normalised words; ASCII separators never cut a UTF-8 sequence."""
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint word ranges covering the same words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class WindowScanner:
    """The automaton of one block of items; patterns are ``b' w1 w2 ... '`` read as Latin-1."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                owners.setdefault(w, set()).update([] if item is None else [item])
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), tuple(sorted(ids))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (end exclusive) and the ids of items with an occurring window."""
        if self.empty or not words:
            return [], set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _ in found])
        ids: set[str] = set().union(*(v[1] for _, v in found))
        return merged([(int(e) - v[0], int(e)) for e, (_, v) in zip(last, found, strict=True)]), ids


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges in the original text for hit word ranges."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in hits]


_SCANNERS: dict[str, WindowScanner] = {}


def _scanner(key: str, items, window: int) -> WindowScanner:
    if key not in _SCANNERS:
        _SCANNERS.clear()  # one block's automaton at a time
        _SCANNERS[key] = WindowScanner(items.value, window)
    return _SCANNERS[key]


def _scan_block(docs: DataFrame, items, window: int) -> DataFrame:
    key, schema = uuid.uuid4().hex, docs.schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, own = WindowScanner(items.value, window) if len(_SCANNERS) > 8 else _scanner(key, items, window), None
        for batch in steps(batches, "text"):
            own = own or batch.schema
            columns = {n: batch.column(n) for n in own.names}
            n_words, hits, ids, spans = [], columns["hits"].to_pylist(), columns["items"].to_pylist(), columns["spans"].to_pylist()
            for k, text in enumerate(utf8(columns["text"])):
                words = words_of(text)
                n_words.append(len(words))
                more, named = scanner.scan(words)
                if more:
                    all_hits = merged([(x["s"], x["e"]) for x in hits[k]] + more)
                    hits[k] = [{"s": s, "e": e} for s, e in all_hits]
                    ids[k] = sorted({*ids[k], *named})
                    spans[k] = [{"s": s, "e": e} for s, e in original_spans(text.decode(), all_hits)]
            columns |= {"n_words": pa.array(n_words, pa.int64())}
            columns |= {n: pa.array(v, own.field(n).type) for n, v in (("hits", hits), ("items", ids), ("spans", spans))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in own.names], schema=own)

    return docs.mapInArrow(kernel, schema)


def scan(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Add to ``docs`` (doc_id, text): n_words, hits (word ranges), items, spans (code points of the original)."""
    spark = docs.sparkSession
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    none = "array<struct<s:int,e:int>>"
    out = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(none).alias("hits"), F.array().cast("array<string>").alias("items"), F.array().cast(none).alias("spans"),
    )
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r["item_id"], r["text"].encode()) for r in part.distinct().collect()]
        out = _scan_block(out, spark.sparkContext.broadcast(rows), window)
    return out


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = scan(docs, bench, window, block_bytes)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.transform("spans", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"))).alias("spans"),
    )
