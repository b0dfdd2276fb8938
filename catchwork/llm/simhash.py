"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 3-word shingles of the lower-cased text, XXH64 with seed 42, 64 majority bits. Two
fingerprints link at ``radius`` or fewer differing bits; components are reachable sets.

Candidates: correlated bits are grouped into the same partition (bit statistics over all distinct
fingerprints). If the thresholds t_i of m partitions satisfy sum(t_i) = radius - m + 1, where -1 leaves
a partition out, two linked fingerprints differ by at most t_i bits in some partition. The thresholds
are allotted by dynamic programming on candidate counts, estimated from block histograms over all distinct
fingerprints. A partition with t_i = 0 is probed by its value; with t_i > 0 by its value
with each set of t_i bits blanked out.

A bucket of more than ``bucket`` fingerprints is not worked on in one task: its members agree on the bits
behind the key, so the same principle is applied again to their remaining bits, until buckets are
small. The remaining bits run out, so this ends with at most 2^11 distinct fingerprints in a bucket, and
nothing is dropped. Within a bucket links are verified against all members, but only a star for each
connected part is passed on, never all pairs.

Cases: null, empty and wordless texts have fingerprint zero, linked like any other. One or two words are
one shingle. Repeated rows give repeated result rows. A null doc_id takes part in linking but names no
component; a component of null ids alone has a null id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.stage import checkpointed
from .arrow import steps, utf8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Largest bucket that one task verifies as a whole.
BUCKET = 2048
BLOCK = 8
BITS = 64


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= 3:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = [0, *ends[:-3].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[b : e - 1], 42) for b, e in zip(begins, ends[2:].tolist(), strict=True)]
    columns = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp): a hash of the text, and the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            fps = np.array([fingerprint(t) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fps)], names=["doc_id", "digest", "fp"])

    rows = docs.selectExpr("doc_id", "cast(text as string) text", "xxhash64(coalesce(cast(text as string), '')) digest")
    return rows.mapInArrow(kernel, f"doc_id {kind}, digest bigint, fp bigint")


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def _sums_row(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(TaskContext.get().partitionId()) % 64], pa.int32()), pa.array([sums.astype("<i8").tobytes()], pa.binary())], names=["k", "sums"])


def _summed(fps: DataFrame, kernel, size: int) -> np.ndarray:
    """The sum of the vectors that ``kernel`` gives, one a task: added up in 64 groups, then here."""

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i8") for x in group.column("sums").to_pylist()], axis=0)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    rows = fps.select("fp").mapInArrow(kernel, "k int, sums binary").groupBy("k").applyInArrow(added, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"], "<i8") for r in rows] or [np.zeros(size, np.int64)], axis=0)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(_array(batch, "fp").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield _sums_row(np.append(both.ravel(), n))

    out = _summed(fps, kernel, BITS * BITS + 1)
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of like size in which correlated bits stand together, greedily."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        rest = sorted(left)
        own = [max(rest, key=lambda b: (like[b, rest].sum(), -b))]
        while len(own) < size:
            own.append(max((b for b in rest if b not in own), key=lambda b: (like[b, own].sum(), -b)))
        left -= set(own)
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def block_histograms(fps: DataFrame, partitions: list[list[int]]) -> np.ndarray:
    """For each block of up to eight bits of each partition, how many fingerprints have each value."""
    blocks = [p[k : k + BLOCK] for p in partitions for k in range(0, len(p), BLOCK)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(blocks), 1 << BLOCK), np.int64)
        for batch in batches:
            x = _array(batch, "fp")
            for k, bits in enumerate(blocks):
                value = sum(((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j for j, b in enumerate(bits))
                counts[k] += np.bincount(value, minlength=1 << BLOCK)
        yield _sums_row(counts.ravel())

    return _summed(fps, kernel, len(blocks) << BLOCK).reshape(len(blocks), 1 << BLOCK).astype(float)


def within(histograms: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of fingerprint pairs that differ by at most 0..most bits, for blocks taken as independent."""
    apart = np.bitwise_count(np.arange(1 << BLOCK)[:, None] ^ np.arange(1 << BLOCK)[None, :])
    share = np.zeros(most + 1)
    share[0] = 1
    for h in histograms:
        p = h / max(h.sum(), 1)
        own = np.array([p @ (apart == d) @ p for d in range(most + 1)])
        share = np.convolve(share, own)[: most + 1]
    return np.cumsum(share)


def allot(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, that add up to ``total`` at the least cost: a dynamic programme over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in own.items():
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best[total]


def plan_probes(fps: DataFrame, radius: int) -> list[tuple[int, int]]:
    """(bits of the key, bits left) of every probe: the cheapest partitioning and its thresholds."""
    n, both = bit_statistics(fps)
    found: list[tuple[float, list[tuple[list[int], int]]]] = []
    for parts in range(max(1, radius), radius + 3):
        partitions = group_bits(n, both, parts)
        histograms, at, cost = block_histograms(fps, partitions), 0, []
        for p in partitions:
            blocks = -(-len(p) // BLOCK)
            near = within(histograms[at : at + blocks], radius)
            at += blocks
            # a probe is a shuffled row; a candidate is one comparison in a vectorised kernel
            cost.append({-1: 0.0} | {t: n * len(list(combinations(p, t))) * 1.0 + n * n / 2 * near[t] * 0.01 for t in range(radius + 1)})
        total, ts = allot(cost, radius - parts + 1)
        found.append((total, list(zip(partitions, ts, strict=True))))
    probes = []
    for bits, t in min(found, key=lambda x: x[0])[1]:
        for blank in combinations(bits, t) if t >= 0 else ():
            key = _mask([b for b in bits if b not in blank])
            probes.append((key, ((1 << BITS) - 1) & ~key))
    return probes


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keyed(fps: DataFrame, probes: list[tuple[int, int]]) -> DataFrame:
    """(fp, key, free): a row for each probe; free are the bits that the key leaves open."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch, "fp")
            for k, (key, free) in enumerate(probes):
                own = _mix(_mix(x & np.uint64(key)) ^ np.uint64(k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x, own, np.full(len(x), free, np.uint64))], names=["fp", "key", "free"])

    return fps.select("fp").mapInArrow(kernel, "fp bigint, key bigint, free bigint")


def _split_again(hot: DataFrame, radius: int) -> DataFrame:
    """Members of too large buckets, keyed anew by shares of the bits that their keys leave open."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, key, free = (_array(batch, c) for c in ("fp", "key", "free"))
            for f in np.unique(free):
                rows, bits = free == f, [b for b in range(BITS) if int(f) >> b & 1]
                for j in range(radius + 1):
                    part = np.uint64(_mask(bits[j :: radius + 1]))
                    own = _mix(_mix(x[rows] & part) ^ _mix(key[rows] + np.uint64(j + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x[rows], own, np.full(rows.sum(), f & ~part, np.uint64))], names=["fp", "key", "free"])

    return hot.select("fp", "key", "free").mapInArrow(kernel, "fp bigint, key bigint, free bigint")


def forest(x: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges from the first fingerprint of each component of links to its others: a component of n has n - 1."""
    a, b, left = [], [], np.unique(x)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        root = todo[0]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                a += [int(root)] * len(found)
                b += found.tolist()
                todo += list(found)
    return a, b


def _links(cold: DataFrame, radius: int) -> DataFrame:
    """Verified links of buckets that stand together in the partitions, sorted by key."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def work(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], edges, [len(keys)]]) if len(keys) else np.zeros(1, int)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            a, b = [fps[two][near].tolist()], [fps[two + 1][near].tolist()]
            for s, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = forest(fps[s : s + n], radius)
                a.append(own[0])
                b.append(own[1])
            a, b = (np.array([y for z in q for y in z], np.uint64).view(np.int64) for q in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys, fps = np.concatenate([keys, _array(batch, "key")]), np.concatenate([fps, _array(batch, "fp")])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))  # the last bucket may go on
            if whole:
                yield work(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        yield work(keys, fps)

    dealt = cold.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(kernel, "a bigint, b bigint")


def near_links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) among distinct fingerprints whose components are those of all pairs within ``radius`` bits."""
    keyed, links = _keyed(fps, plan_probes(fps, radius)), []
    while True:
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "k")
        held = checkpointed(keyed.join(sizes, F.col("key") == F.col("k")).drop("k"))
        exhausted = F.bit_count("free") <= 11
        links.append(_links(held.where((F.col("size") <= bucket) | exhausted), radius))
        hot = held.where((F.col("size") > bucket) & ~exhausted)
        if hot.isEmpty():
            break
        keyed = _split_again(hot, radius)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def grouped(docs: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, digest (of the text), fp, root (a fingerprint that stands for the component), component_id."""
    own = checkpointed(fingerprints(docs))
    # exact copies meet in one row, combined map-side
    groups = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(groups.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return grouped(docs, radius, bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
