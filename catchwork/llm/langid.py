"""Language identification: script ranges, per-word scores and a Viterbi path over words.

A word is a run of letters and marks. Each language has the log probabilities of hashed character trigrams
(word edges included), counted over all training rows; a word's score in a language is the sum over its characters.
The script of a word's first letter narrows its candidates to the languages that use the script in training.
A Viterbi path over the words of a text, with a penalty for switching, labels spans of mixed text; the language with
the most letters on the path is the text's, and its share of letters the score.

Training reads the text and the language of the training rows only. The model has at most ``SLOTS`` counts a
language, whatever the size of the corpus.

Cases: null text, or text without a letter, is ``und`` with score 0; so is every text if no row can be trained on. A null
id counts as the empty string in the fold's checksum. Repeated rows give repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import steps

SLOTS = 1 << 16
#: Natural-log cost of a change of language between two words.
SWITCH = 12.0
#: Share of a language's training words that a script needs to be one of the language's.
SCRIPT_SHARE = 0.001
#: Code point ranges of the main scripts (first, last, script).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x2FFFF, "han"),
]
_NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 2 letter, 1 mark, 0 other; and the script's number."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if (g := unicodedata.category(chr(c))[0]) in "LM":
            kind[c] = 2 if g == "L" else 1
    script = np.zeros(0x110000, np.uint8)
    for a, b, s in SCRIPTS:
        script[a : b + 1] = _NAMES.index(s)
    return kind, script


def lowered(text: str) -> str:
    """Lower case with the original's offsets: a character whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text), strict=True))


class Words:
    """The words of some texts: per letter its trigram slot, per word its first letter, script and text."""

    def __init__(self, texts: list[str]):
        kind, script = _tables()
        low = [lowered(t) for t in texts]
        x = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)
        inside = kind[x] > 0
        y = np.full(len(x) + 2, 32, np.uint32)  # word edges are blanks, and so are the ends
        y[1:-1][inside] = x[inside]
        h = (y[:-2] * np.uint32(73856093)) ^ (y[1:-1] * np.uint32(19349663)) ^ (y[2:] * np.uint32(83492791))
        h ^= h >> np.uint32(15)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        self.at = np.flatnonzero(inside)
        self.slot = (h & np.uint32(SLOTS - 1))[self.at].astype(np.int32)
        self.start = np.flatnonzero(first[self.at])  # of each word, among the letters
        self.script = script[x[self.at[self.start]]]
        self.letters = np.diff(np.append(self.start, len(self.at)))
        self.text = np.searchsorted(self.begins, self.at[self.start], side="right") - 1
        has = np.zeros(len(texts), bool)
        has[np.searchsorted(self.begins, self.at[kind[x[self.at]] == 2], side="right") - 1] = True
        self.has_letter = has


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == fold


class Model:
    """Languages, their trigram log probabilities and their scripts."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = grams.sum(axis=1, keepdims=True)
        self.logs = np.ascontiguousarray(np.log((grams + 0.1) / (total + 0.1 * SLOTS)).T.astype(np.float32))
        uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        uses &= scripts > 0
        uses[:, ~uses.any(axis=0)] = True  # a script that no language uses narrows nothing
        self.barred = np.where(uses.T, 0, -1e6).astype(np.float32)

    def label(self, w: Words, switch: float) -> np.ndarray:
        """The language of each word on its text's best path; the texts advance side by side."""
        n = len(w.start)
        if not n:
            return np.zeros(0, np.uint8)
        scores = np.add.reduceat(self.logs[w.slot], w.start, axis=0) + self.barred[w.script]
        first = np.flatnonzero(np.diff(w.text, prepend=-1))
        lengths = np.diff(np.append(first, n))
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        steps_left = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts that have a t-th word
        came, jumped = np.zeros(n, np.uint8), np.zeros((n, len(self.langs)), bool)
        v = scores[first]
        for t in range(1, int(lengths[0])):
            k = steps_left[t]
            at, u = first[:k] + t, v[:k]
            best = u.argmax(axis=1)
            other = u[np.arange(k), best][:, None] - switch
            jump = other > u
            came[at], jumped[at] = best, jump
            v[:k] = np.where(jump, other, u) + scores[at]
        state, out = v.argmax(axis=1), np.zeros(n, np.uint8)
        for t in range(int(lengths[0]) - 1, -1, -1):
            k = steps_left[t]
            at, s = first[:k] + t, state[:k]
            out[at] = s
            if t:
                state[:k] = np.where(jumped[at, s], came[at], s)
        return out


def fit(docs: DataFrame) -> Model:
    """Count hashed trigrams and scripts of the rows' texts by language; null texts and languages are left out."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in steps(batches, "text", 1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            w = Words(batch.column("text").to_pylist())
            letters = np.repeat(w.text, w.letters)
            for lang in set(langs):
                own = langs == lang
                c = grams.setdefault(lang, np.zeros(SLOTS + len(_NAMES), np.int64))
                c[:SLOTS] += np.bincount(w.slot[own[letters]], minlength=SLOTS)
                c[SLOTS:] += np.bincount(w.script[own[w.text]], minlength=len(_NAMES))
        for lang, c in grams.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "k", "n"])

    rows = docs.selectExpr("cast(text as string) text", "cast(lang as string) lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(kernel, "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), SLOTS + len(_NAMES)))
    table[np.searchsorted(langs, counts["lang"]) if len(langs) else [], counts["k"].to_numpy(np.int64)] = counts["n"]
    return Model(langs, table[:, :SLOTS], table[:, SLOTS:])


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """Per document: doc_id, lang_pred, score, spans (start, end, lang; code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in steps(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            w = Words(texts)
            if model.langs and len(w.start):
                label = model.label(w, switch)
                share = np.zeros((len(texts), len(model.langs)))
                np.add.at(share, (w.text, label), w.letters)
                ends = w.at[w.start + w.letters - 1] + 1
                cuts = np.flatnonzero((np.diff(w.text, prepend=-1) != 0) | (np.diff(label.astype(int), prepend=-1) != 0))
                for a, b in zip(cuts, np.append(cuts[1:], len(label)), strict=True):
                    k = w.text[a]
                    spans[k].append({"start": int(w.at[w.start[a]] - w.begins[k]), "end": int(ends[b - 1] - w.begins[k]), "lang": model.langs[label[a]]})
                best = share.argmax(axis=1)
                for k in np.flatnonzero(w.has_letter):
                    names[k], scores[k] = model.langs[best[k]], float(share[k, best[k]] / share[k].sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "spans"])

    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(kernel, schema)


def identify(docs: DataFrame, folds: int = 5, fold: int = 0, switch: float = SWITCH) -> DataFrame:
    """Fit on the rows outside the held-out fold, predict every row: doc_id, held_out, lang_pred, score, spans."""
    model = fit(docs.where(~held_out("doc_id", folds, fold)))
    found = predict(docs, model, switch)
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score", "spans")
