"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and one end. Every token is read as bits, and every bit is predicted by mixed hashed contexts. First
the token's class, the ``CLASS_BITS`` upper bits of its checksum, then its path in the Huffman tree of its class, whose leaves are
the ``HEAD`` most frequent training tokens and one escape: the contexts are no word, the word before and the two words before,
across the whole text. An escaped token is spelled: the bits of its bytes (each byte's path in a Huffman tree, a blank at the
end) are predicted by hashed contexts of the 2 and 3 bytes before and of all bytes of the word so far, whose counts are those of the
training texts. Every context gives a logit from its counts of zeros and ones; the logits are mixed with weights chosen by a gate
(how well the two longer contexts are known), and the mix is refined by an adaptive table over gate and logit. A text's score
is the sum of the log10 probabilities of its bits; its total bits divided by its bytes are the bits per byte. The spelling of a
token doesn't depend on the words before, so it is scored once for each distinct token.

Context tables are sums over all training texts, and over their distinct tokens, by count, for the spelling (tokens with a path
of their own count once there). Weights and adaptive tables are trained online over the same rows, each bit without its own
occurrence: rows are dealt by hash to shards of about ``SHARD`` tokens, read in the order of their hashes, and the shards' results are
averaged by their bits, so scores don't depend on the order of rows. Then they are frozen. Slots grow with the number of
training tokens (for the spelling, of their distinct bytes), from ``SLOTS`` to ``MOST_SLOTS``, the bound of a task's memory;
contexts beyond them share slots, and the weights are trained with what that costs. The lexicon with its counts and spelling
scores grows with the corpus and stays distributed: the ``HEAD`` most frequent tokens are broadcast, the others are joined.

Cases: null text is empty: its end alone is scored. Without training rows every context is unknown and every bit costs one
bit; the base is zero counts (0 tokens, 0 distinct: log10(1/1)). Repeated rows give repeated result rows. Other columns are
ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import checkpointed
from .arrow import steps, utf8
from .langid import held_out

CONTEXTS = 3
#: More bits know more of what follows the words before, at a cost in proportion.
CLASS_BITS = 4
#: Slots of the shortest context, and bounds for the others.
FIRST_SLOTS = 1 << 18
SLOTS = 1 << 20
MOST_SLOTS = 1 << 22
BLOCK = 1 << 14
#: Tokens of a training shard.
SHARD = 1_000_000
HEAD = 100_000
#: Bytes of a distinct token, about.
LETTERS = 8
#: Tokens that a task holds at once to count them.
COUNTED = 4_000_000
#: Bits of a training step, tokens or words that the kernels read at once, and bytes that counting and scoring read at once
#: (every reading makes a hash table of the words with a path anew, 10 ms); training reads less, as its steps end with a reading.
BATCH = 1 << 14
_STEP = 1 << 13
READ_BYTES = 3 << 20
TRAIN_BYTES = 1 << 20
RATE = 0.05
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NODE = np.uint32(0x9E3779B1)
_MIX = np.uint32(0x85EBCA6B)
_GATES = 16
_CELLS = 129
#: Counts of a slot of a longer context stop here.
_FULL = 0xFFFF
#: Steps of a logit of 1.
_STEPS = 600


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words; the end is not among them."""
    return text.translate(_LOWER).split()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As ``tokens``, over a column: the words of all texts, one after the other, and their number by text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    own = pc.not_equal(pc.binary_length(flat), 0)  # blanks at a text's sides leave empty pieces
    if pc.all(own).as_py():
        return flat, np.diff(offsets).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(own.to_numpy(zero_copy_only=False))])
    return flat.filter(own), np.diff(before[offsets])


def checksums(words: pa.Array) -> np.ndarray:
    """The CRC-32 of binary words, cut from the column's bytes: Arrow's own way to Python objects takes three times as long."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    return np.fromiter((zlib.crc32(data[a:b]) for a, b in pairwise((ends - ends[0]).tolist())), np.uint32, len(words))


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By leaf the begin of its path (one more at the end), and the inner nodes and bits of all paths."""
    n = len(counts)
    order = np.argsort(np.array(counts, np.float64), kind="stable").tolist()
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    made: list[int] = []
    i = j = 0
    for k in range(n - 1):
        total = 0
        for s in (0, 1):
            if j >= len(made) or (i < n and counts[order[i]] <= made[j]):
                node, total, i = order[i], total + counts[order[i]], i + 1
            else:
                node, total, j = n + j, total + made[j], j + 1
            parent[node], side[node] = n + k, s
        made.append(total)
    at, leaves, found = np.arange(n), np.arange(n), []
    while len(leaves := leaves[(own := at[leaves]) != 2 * n - 2]):
        own = own[own != 2 * n - 2]
        found.append((leaves, parent[own] - n, side[own]))
        at[leaves] = parent[own]
    if not found:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    leaf, node, bit = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(leaf, kind="stable")
    return np.searchsorted(leaf[by], np.arange(n + 1)), node[by].astype(np.uint32), bit[by]


def _joined(code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Nodes and bits of all paths in one array, to be looked up together."""
    return code[1].astype(np.uint32) << np.uint32(1) | code[2]


def _paths(begin: np.ndarray, joined: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of the paths of all leaves, and the nodes and bits of the paths, one after the other."""
    first = begin.take(leaves)
    sizes = begin.take(leaves + 1) - first
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    step = joined.take(at, mode="clip")
    return sizes, step >> np.uint32(1), (step & np.uint32(1)).astype(np.uint8)


def _slots(h: np.ndarray, sizes: np.ndarray, mixed: np.ndarray, shift: np.uint32, value: np.ndarray | None = None) -> np.ndarray:
    """Of the bits of all paths, the slots of a context that is hashed by leaf: ``mixed`` tells a path's nodes apart.

    With ``value`` the places of the bits in a table that has a zero's and a one's entry for each slot.
    """
    x = np.repeat(h, sizes)
    x ^= mixed
    x *= _MIX
    x >>= shift
    return x.astype(np.intp) if value is None else _places(x, value)


def _places(slots: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The entries of the bits in a table that has a zero's and a one's for each slot."""
    x = slots << np.uint32(1)
    x |= value
    return x.astype(np.intp)


def _back(x: np.ndarray, inside: np.ndarray, by: int) -> np.ndarray:
    """The entries ``by`` places before, 0 before a row's begin."""
    return np.where(inside >= by, np.concatenate([np.zeros(by, x.dtype), x[:-by]])[: len(x)], 0).astype(np.uint32)


class Classes:
    """The class bits of texts, and the bits of their words within the classes, with the slots of their contexts.

    ``words`` are the words with a path of their own, with their counts; ``escapes`` count the others by class. A class's words and
    its escape are the leaves of a Huffman tree below the class. Without ``words`` there are class bits alone.
    """

    def __init__(self, slots: int, words: dict[bytes, float] | None = None, escapes: list[float] | None = None):
        classes, down = np.arange(1 << CLASS_BITS, dtype=np.uint32)[:, None], np.arange(CLASS_BITS, dtype=np.uint32)
        upper = (classes | np.uint32(1 << CLASS_BITS)) >> (np.uint32(CLASS_BITS) - down)
        values = ((classes >> (np.uint32(CLASS_BITS - 1) - down)) & np.uint32(1)).astype(np.uint8)
        paths: dict[int, tuple[np.ndarray, np.ndarray]] = {k: (upper[k], values[k]) for k in range(1 << CLASS_BITS)}
        self.words, inner = {}, 1 << CLASS_BITS
        own: list[list[bytes]] = [[] for _ in paths]
        for w in words or {}:
            own[zlib.crc32(w) >> (32 - CLASS_BITS)].append(w)
        for k, members in enumerate(own):
            begin, nodes, bits = huffman([escapes[k] if escapes else 1, *[words[w] for w in members]])
            for i, w in enumerate([None, *members]):
                # leaf k is the escape of class k
                leaf = k if w is None else self.words.setdefault(w, (1 << CLASS_BITS) + len(self.words))
                a, b = begin[i], begin[i + 1]
                paths[leaf] = np.concatenate([upper[k], nodes[a:b] + np.uint32(inner)]), np.concatenate([values[k], bits[a:b]])
            inner += len(members)
        order = [paths[leaf] for leaf in range(len(paths))]
        self.code = np.concatenate([[0], np.cumsum([len(n) for n, _ in order])]), np.concatenate([n for n, _ in order]), np.concatenate([b for _, b in order])
        self.joined = _joined(self.code)
        self.sums = np.array([0] * len(own) + [zlib.crc32(w) for w in self.words], np.uint32)
        self.known = pa.array(list(self.words), pa.binary())
        self.step = _STEP // 4 if words else _STEP
        self.widths = [inner, slots, slots]
        self.shift = np.uint32(33 - slots.bit_length())

    def read(self, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of some texts one after the other, each text's end included, their checksums and leaves, and the places of the escaped ones."""
        flat = list(chain.from_iterable(chain(t, (b"",)) for t in texts))
        leaf = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        far = np.flatnonzero(leaf < 0)
        key = self.sums[leaf]
        key[far] = np.fromiter((zlib.crc32(flat[k]) for k in far.tolist()), np.uint32, len(far))
        leaf[far] = key[far] >> np.uint32(32 - CLASS_BITS)
        return flat, key, leaf, far

    def bits(self, texts: pa.Array, leaves: np.ndarray | None = None, placed: bool = False) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Of the bits, some tokens at a time: their text, slots by context and value. ``leaves``: what the leaves are counted in, too.

        ``placed``: a zero's or a one's place, two for each slot, instead of the slots.
        """
        _, _, key, sizes, leaf, _ = self.read_column(texts)
        if leaves is not None:
            leaves += np.bincount(leaf, minlength=len(leaves))
        yield from self.of(key, sizes, leaf, placed)

    def read_column(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """As ``read``, over a column: the words, the places of the escaped tokens, checksums, texts' sizes, leaves, and the escaped tokens.

        Words are looked up by one hash join with those that have a path, not one by one.
        """
        words, own = words_of(texts)
        words = words.cast(pa.binary())
        sizes = own + 1
        end = np.cumsum(sizes) - 1
        inner = np.ones(len(words) + len(sizes), bool)
        inner[end] = False
        leaf = np.full(len(inner), self.words.get(b"", -1), np.int64)
        found = pc.fill_null(pc.index_in(words, value_set=self.known), -1 - (1 << CLASS_BITS)).to_numpy().astype(np.int64)
        found += 1 << CLASS_BITS
        leaf[inner] = found
        far = np.flatnonzero(leaf < 0)
        key = self.sums.take(leaf, mode="clip")
        ends = ~inner[far]
        if ends.all():
            spelt = pa.array([b""] * len(far), pa.binary())
        else:
            # so many ends stand before a token
            spelt = words.take(pa.array(np.where(ends, 0, far - np.searchsorted(end, far))))
            spelt = pc.if_else(pa.array(~ends), spelt, b"") if ends.any() else spelt
        key[far] = checksums(spelt)
        leaf[far] = key[far] >> np.uint32(32 - CLASS_BITS)
        return words, far, key, sizes, leaf, spelt

    def of(self, key: np.ndarray, sizes: np.ndarray, leaf: np.ndarray, placed: bool = False) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        inside = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # a text's begin is no word
        one = np.where(inside > 0, (_back(key, inside, 1) + np.uint32(1)) * _MIX, np.uint32(7))
        one ^= one >> np.uint32(15)
        two = (one + _back(key, inside, 2) * _NODE + (inside > 1).astype(np.uint32)) * _MIX
        two ^= two >> np.uint32(13)
        for a in range(0, len(key), self.step):
            n, node, value = _paths(self.code[0], self.joined, leaf[a : a + self.step])
            mixed = node * _NODE
            longer = [_slots(h[a : a + self.step], n, mixed, self.shift, value if placed else None) for h in (one, two)]
            yield np.repeat(text[a : a + self.step], n), [_places(node, value) if placed else node.astype(np.intp), *longer], value


class Spelling:
    """The bits of words with the slots of their contexts; ``sizes``: how often each byte value occurs, about."""

    def __init__(self, sizes: np.ndarray, slots: int):
        self.code = huffman((sizes + 1).tolist())
        self.joined = _joined(self.code)
        self.widths = [FIRST_SLOTS, slots, slots]
        self.shifts = [np.uint32(33 - w.bit_length()) for w in self.widths]

    def bits(self, words: pa.Array, placed: bool = False) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """Of the bits, some words at a time: their word, slots by context and value; ``placed`` as in ``Classes``."""
        rows = utf8(words)
        for a in range(0, len(rows), _STEP // 4):
            words = rows[a : a + _STEP // 4]
            x = np.frombuffer(b" ".join([*words, b""]), np.uint8)
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            word = np.repeat(np.arange(a, a + len(words), dtype=np.int32), sizes)
            inside = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n, node, value = _paths(self.code[0], self.joined, x.astype(np.int64))
            h, found, y = np.full(len(x), 0x27D4EB2F, np.uint32), [], x.astype(np.uint32) + np.uint32(1)
            for by in range(1, 4):
                h = h * _NODE + _back(y, inside, by)
                if by > 1:
                    found.append(h)
            # all bytes of the word so far: a sum of bytes by the powers of their places
            power = np.concatenate([np.ones(1, np.uint32), np.cumprod(np.full(int(sizes.max(initial=1)), _NODE), dtype=np.uint32)])
            sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(y * power[inside], dtype=np.uint32)])
            found.append((sums[:-1] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)) * _NODE + inside.astype(np.uint32))
            found = [(h ^ (h >> np.uint32(15))) * _MIX for h in found]
            mixed = node * _NODE
            yield np.repeat(word, n), [_slots(h, n, mixed, s, value if placed else None) for h, s in zip(found, self.shifts, strict=True)], value


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as 16-bit states: the logit in steps, above two bits of how well the context is known."""
    logit = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
    known = np.minimum(3, np.ceil(np.log2(1 + zeros + ones) / 3)).astype(np.int16)
    return (np.clip(np.rint(logit * _STEPS), -8000, 8000).astype(np.int16) << np.int16(2)) | known


class Mixer:
    """The states of all slots with the weights and the adaptive table.

    ``zeros`` and ``ones`` are the counts of the slots by context. For training a slot has two states, each
    without one occurrence of the bit that is looked up.
    """

    def __init__(self, zeros: list[np.ndarray], ones: list[np.ndarray], training: bool = False):
        if training:
            none = np.float32(0)
            self.states = [np.stack([states(np.maximum(z - 1, none), o), states(z, np.maximum(o - 1, none))], axis=1).ravel() for z, o in zip(zeros, ones, strict=True)]
        else:
            self.states = [states(z, o) for z, o in zip(zeros, ones, strict=True)]
        self.reset()

    def reset(self) -> None:
        """Weights and adaptive table as before any training."""
        self.weights = np.tile(np.array([[0.8], [0.1], [0.1]], np.float32), (1, _GATES))
        self.squares = np.full((CONTEXTS, _GATES), 1e-4)
        self.table = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, _CELLS))), (_GATES, 1)).astype(np.float32)

    def _inputs(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits by context, and gates."""
        # slots are in range by their making; checking each again costs as much as the look-up
        own = [t.take(s, mode="clip") for t, s in zip(self.states, slots, strict=True)]
        gate = ((own[1] & np.int16(3)) << np.int16(2)) | (own[2] & np.int16(3))
        return [(q >> np.int16(2)) * np.float32(1 / _STEPS) for q in own], gate.astype(np.intp)

    def _mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        out = self.weights[0].take(gate, mode="clip")
        out *= x[0]
        for k in range(1, CONTEXTS):
            own = self.weights[k].take(gate, mode="clip")
            own *= x[k]
            out += own
        return out

    def _cells(self, mixed: np.ndarray, gate: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Twice the cell of the adaptive table for each bit (the logit to the nearest step, by gate), one more for a one."""
        x = np.maximum(mixed, np.float32(-8))
        np.minimum(x, np.float32(8), out=x)
        x += np.float32(8)
        x *= np.float32((_CELLS - 1) / 16)
        x += np.float32(0.5)
        cell = gate.astype(np.int16)
        cell *= np.int16(_CELLS)
        cell += x.astype(np.int16)
        cell <<= np.int16(1)
        cell |= value
        return cell.astype(np.intp)

    def train(self, slots: list[np.ndarray], value: np.ndarray, placed: bool = False) -> None:
        """Go on over some bits, by their slots or places: weights by the gradient, the table towards the outcomes."""
        inputs, gates = self._inputs(slots if placed else [s * 2 + value for s in slots])
        flat = self.table.reshape(-1)
        for s in range(0, len(value), BATCH):
            x, g, y = [c[s : s + BATCH] for c in inputs], gates[s : s + BATCH], value[s : s + BATCH]
            mixed = self._mixed(x, g)
            wrong = y - 1 / (1 + np.exp(-mixed))
            seen, ones = np.bincount(self._cells(mixed, g, y), minlength=2 * len(flat)).reshape(-1, 2).T
            seen = seen + ones
            size = seen.reshape(_GATES, _CELLS).sum(axis=1)
            slope = np.stack([np.bincount(g, wrong * c, _GATES) for c in x]) / np.maximum(size, 1)
            slope *= np.minimum(1, size / 256)  # a gate with few bits in the step moves little
            self.squares += slope * slope
            self.weights += (RATE * slope / np.sqrt(self.squares)).astype(np.float32)
            # a cell moves towards the batch's outcomes by their number, never past them
            flat += ((ones - seen * flat) / (seen + 50)).astype(np.float32)

    def logs(self) -> np.ndarray:
        """log10 of the shares of zeros and ones in the cells of the adaptive table."""
        return np.log10(np.stack([1 - self.table.ravel(), self.table.ravel()], axis=1)).ravel()

    def log10(self, slots: list[np.ndarray], value: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
        """The bits' log10 probabilities; those of a bit's two values add up to 1, and none is 0."""
        x, gate = self._inputs(slots)
        return (self.logs() if logs is None else logs).take(self._cells(self._mixed(x, gate), gate, value), mode="clip")

    def scores(self, bits: Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]], rows: int) -> np.ndarray:
        """log10 probability of each row's bits."""
        out, logs = np.zeros(rows), self.logs()
        for owner, slots, value in bits:
            # some texts at a time: their bits stand together
            own = np.bincount(owner - owner[0], self.log10(slots, value, logs))
            out[owner[0] : owner[0] + len(own)] += own
        return out


def lexicon(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """(word, c): every distinct token of all texts with its training count; the end is the empty word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: list[pa.Array], counted: bool) -> Iterator[pa.RecordBatch]:
            found = pa.chunked_array(words, pa.string()).value_counts()
            for chunk in found.chunks if isinstance(found, pa.ChunkedArray) else [found]:
                n = chunk.field("counts") if counted else pa.array(np.zeros(len(chunk), np.int64))
                yield pa.RecordBatch.from_arrays([chunk.field("values").cast(pa.binary()), n], names=["word", "c"])

        held: dict[bool, list[pa.Array]] = {False: [], True: []}
        sizes = {False: 0, True: 0}
        for batch in steps(batches, "text"):
            for side in (False, True):
                own = batch.column("text").filter(pc.equal(batch.column("held"), side))
                if len(own):
                    words, _ = words_of(own)
                    held[side] += [words, pa.array([""] * len(own))]
                    sizes[side] += len(words) + len(own)
                if sizes[side] > COUNTED:
                    yield from out(held[side], not side)
                    held[side], sizes[side] = [], 0
        for side in (False, True):
            if held[side]:
                yield from out(held[side], not side)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    rows = docs.select(F.col("text").cast("string").alias("text"), held_out("doc_id", folds, fold).alias("held"))
    return rows.mapInArrow(kernel, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def context_tables(rows: DataFrame, reader: Broadcast) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Zeros and ones of every slot by context over all rows (text), as many times as their ``weight``, if they have one."""
    widths, weighted = reader.value.widths, "weight" in rows.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 * w, np.uint32) for w in widths]
        # the context of no word: nodes are met as often as the leaves below them
        alone = [np.zeros(len(reader.value.code[0]) - 1, np.int64)] if isinstance(reader.value, Classes) and not weighted else []
        for batch in steps(batches, "text", READ_BYTES):
            weight = batch.column("weight").to_numpy().astype(np.uint32) if weighted else None
            for owner, places, _ in reader.value.bits(batch.column("text"), *alone, placed=True):
                for k in range(len(alone), CONTEXTS):
                    np.add.at(sums[k], places[k], weight[owner] if weighted else np.uint32(1))
        for leaves in alone:
            sums[0] += np.bincount(reader.value.joined, np.repeat(leaves, np.diff(reader.value.code[0])), len(sums[0])).astype(np.uint32)
        pack = zstandard.ZstdCompressor(1)
        for k, x in enumerate(sums):
            for b in range(0, len(x), BLOCK):
                if (part := x[b : b + BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], names=["context", "block", "sums"])

    def added(group: pa.Table) -> pa.Table:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(0, np.float64)
        for x in group.column("sums"):
            own = np.frombuffer(unpack.decompress(x.as_py()), np.uint32)
            total = own + (total if len(total) else 0.0)
        packed = total.astype("<f4") if group.column("context")[0].as_py() == 0 else np.minimum(total, _FULL).astype("<u2")
        return pa.table({"context": pa.array([group.column("context")[0].as_py()], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int32()), "sums": pa.array([packed.tobytes()], pa.binary())})

    out = [np.zeros(2 * w, np.float32 if k == 0 else np.uint16) for k, w in enumerate(widths)]
    schema = "context int, block int, sums binary"
    # each task holds one set of tables, so there are no more tasks than run at once
    few = rows.select("text", *(["weight"] if weighted else [])).coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    for r in few.mapInArrow(kernel, schema).groupBy("context", "block").applyInArrow(added, schema).toLocalIterator():
        own = np.frombuffer(r["sums"], "<f4" if r["context"] == 0 else "<u2")
        out[r["context"]][r["block"] : r["block"] + len(own)] = own
    return [x[::2].copy() for x in out], [x[1::2].copy() for x in out]


def among_largest(df: DataFrame, value: Column, most: int) -> Column:
    """Whether a row is among those with the largest positive values, ``most`` at the most: cut at a step of a logarithmic histogram.

    The histogram has a row for each of a few thousand steps, so the cut needs no sort and no row of the data on the driver.
    """
    step = F.floor(F.log2(value) * 64).cast("int")
    cut, total = None, 0
    for r in df.where(value > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total > most:
            break
        cut = r["step"]
    return (value > 0) & (step >= cut) if cut is not None else F.lit(False)


def slots_for(vocabulary: int) -> int:
    """Slots of a longer context: a power of two, at least one for each distinct training token, within the bounds."""
    return min(MOST_SLOTS, max(SLOTS, 1 << max(0, vocabulary - 1).bit_length()))


def fit(rows: DataFrame, n: int, reader: Broadcast, shard: int = SHARD) -> Mixer:
    """Tables, weights and adaptive table over the bits that the broadcast ``reader`` finds in all rows (text), of ``n`` tokens."""
    tables = context_tables(rows, reader)
    mixer = Mixer(*tables)
    # states are made once here, not in every task
    learner = rows.sparkSession.sparkContext.broadcast(Mixer(*tables, training=True))
    del tables

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(own: Mixer, k: int, bits: int) -> pa.RecordBatch:
            both = np.concatenate([own.weights.ravel(), own.table.ravel()]).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bits], pa.int64()), pa.array([both.tobytes()], pa.binary())], names=["shard", "bits", "learnt"])

        def learn(texts: list[str | bytes]) -> int:
            bits = 0
            for _, places, value in reader.value.bits(pa.array(texts), placed=True):
                own.train(places, value, placed=True)
                bits += len(value)
            return bits

        own, at, bits, held, size = None, None, 0, [], 0
        for batch in steps(batches, "text"):
            for k, t in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if own is None:
                    own, at = copy.copy(learner.value), k
                    own.reset()
                if held and (k != at or size > TRAIN_BYTES):
                    bits, held, size = bits + learn(held), [], 0
                if k != at:
                    yield out(own, at, bits)
                    own.reset()
                    at, bits = k, 0
                held.append(t)
                size += len(t)
        if held:
            bits += learn(held)
            yield out(own, at, bits)

    shards = 1 + n // shard
    dealt = rows.select("text", F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), F.xxhash64("text", F.lit(1)).alias("place"))
    read = dealt.repartition("shard").sortWithinPartitions("shard", "place").select("text", "shard").mapInArrow(kernel, "shard bigint, bits bigint, learnt binary")
    found = sorted(read.collect(), key=lambda r: r["shard"])  # a few kilobytes a shard
    if found:
        learnt = np.average([np.frombuffer(r["learnt"]) for r in found], axis=0, weights=[r["bits"] for r in found]).astype(np.float32)
        mixer.weights = learnt[: mixer.weights.size].reshape(mixer.weights.shape)
        mixer.table = np.clip(learnt[mixer.weights.size :].reshape(mixer.table.shape), 1e-5, 1 - 1e-5)
    learner.unpersist()
    return mixer


def score(docs: DataFrame, folds: int = 7, fold: int = 2, head: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    context = docs.sparkSession.sparkContext
    lex = checkpointed(lexicon(docs, folds, fold))
    size = lex.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    n, log_all = int(size["n"]), float(np.log10(int(size["n"]) + 1 * (int(size["v"]) + 1)))
    training = docs.where(~held_out("doc_id", folds, fold)).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    types = max(1, int(size["v"]))
    frequent = among_largest(lex, F.col("c"), head)
    top = {bytes(r["word"]): r["c"] for r in lex.where(frequent).collect()}
    end = lex.where(F.octet_length("word") == 0).first()
    top = dict(sorted(({b"": end["c"] if end else 0} | top).items()))
    own = np.zeros(1 << CLASS_BITS)
    for w, c in top.items():
        own[zlib.crc32(w) >> (32 - CLASS_BITS)] += c
    sums = {r["label"]: r["c"] for r in lex.groupBy(_class("word").alias("label")).agg(F.sum("c").alias("c")).collect()}
    others = [float(sums.get(k, 0) - own[k]) + types / len(own) for k in range(len(own))]
    paths = Classes(slots_for(n), {w: float(max(1, c)) for w, c in top.items()}, others)
    classes, counts = context.broadcast(paths), context.broadcast(np.array([0] * len(own) + [top[w] for w in paths.words], np.float64))
    mixer = context.broadcast(fit(training, n, classes))

    # the spelling is that of words without a path: the others count once there
    with_path = frequent | (F.octet_length("word") == 0)
    spelt = lex.where("c > 0").select(F.col("word").alias("text"), F.when(with_path, 1).otherwise(F.col("c")).cast("long").alias("weight"))
    spelling = context.broadcast(Spelling(_byte_sizes(lex), slots_for(LETTERS * types)))
    speller = context.broadcast(fit(spelt, types, spelling))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "word"):
            p = speller.value.scores(spelling.value.bits(batch.column("word")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p)], names=["word", "c", "p"])

    # words with a path need no spelling
    rated = checkpointed(lex.where(~with_path).mapInArrow(rate, "word binary, c bigint, p double"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["tokens", "bytes", "known", "base", "score", "copies"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by leaf; an escape stands for other words
        logs, known = np.log10(counts.value + 1).astype(np.longdouble), (counts.value > 0).astype(np.int64)
        for batch in steps(batches, "text", READ_BYTES):
            ids, digests, n = batch.column("doc_id"), batch.column("digest").to_numpy(), batch.num_rows
            words, far, key, sizes, leaf, spelt = classes.value.read_column(batch.column("text"))
            begins = np.cumsum(sizes) - sizes
            per = lambda x: np.add.reduceat(x.take(leaf), begins)
            letters = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy())])
            used = np.diff(letters[np.concatenate([[0], np.cumsum(sizes - 1)])]) + sizes
            scores = mixer.value.scores(classes.value.of(key, sizes, leaf), n)
            coded = spelt.dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pair, times = np.unique((np.searchsorted(begins, far, "right") - 1) * kinds + coded.indices.to_numpy(), return_counts=True)
            at, more = pair // kinds, len(pair)
            # the text's own row: a key that no word can be, spread over all partitions
            own = [b" %d" % d for d in digests.tolist()]
            both = np.concatenate([np.arange(n), at])
            place = pa.array(np.concatenate([np.arange(n), np.full(more, -1)]), mask=np.arange(n + more) >= n)
            sums = [sizes, used, per(known), per(logs).astype(float), scores, np.ones(n, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(both)), pa.array(digests[both]), pa.concat_arrays([pa.array(own, pa.binary()), coded.dictionary.take(pa.array(pair % kinds))]),
                    pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                    pa.StructArray.from_arrays([pa.array(x) for x in sums], names=names).take(place),
                ],
                names=["doc_id", "digest", "word", "n", "own"],
            )

    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    schema = f"doc_id {kind}, digest bigint, word binary, n bigint, own struct<tokens: bigint, bytes: bigint, known: bigint, base: double, score: double, copies: bigint>"
    # a word is one row of the rated, so their partitions are even, and need not be sorted
    parts = keyed.mapInArrow(look_up, schema).join(rated.withColumnRenamed("word", "w").hint("shuffle_hash"), F.col("word") == F.col("w"), "left")
    hit = F.col("c").isNotNull()
    own = lambda c: F.coalesce(f"own.{c}", F.lit(0))
    sums = parts.groupBy("doc_id", "digest").agg(
        F.sum("own.tokens").alias("tokens"),
        F.sum("own.bytes").alias("bytes"),
        F.sum(own("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(own("base") + F.when(hit, F.col("n") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("base"),
        F.sum(own("score") + F.when(hit, F.col("n") * F.col("p")).otherwise(0.0)).alias("score"),
        F.sum("own.copies").alias("copies"),
    )
    # repeated rows have met in one group: their sums are multiples
    each = sums.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    per = lambda c: F.col(c) / F.col("copies")
    return each.select(
        "doc_id",
        held_out("doc_id", folds, fold).alias("held_out"),
        per("tokens").cast("long").alias("n_tokens"),
        per("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (per("base") - per("tokens") * log_all).alias("base_score"),
        per("score").alias("score"),
        (-per("score") / np.log10(2.0).item() / per("bytes")).alias("bits_per_byte"),
    )


def _class(word: str) -> Column:
    return F.shiftright(F.crc32(word), 32 - CLASS_BITS)


def _byte_sizes(lex: DataFrame) -> np.ndarray:
    """How often each byte value occurs in the distinct training tokens; the blank once a token."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(256, np.int64)
        for batch in steps(batches, "word"):
            sizes += np.bincount(np.frombuffer(b" ".join([*utf8(batch.column("word")), b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(sizes)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in lex.where("c > 0").select("word").mapInArrow(kernel, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out
