"""Every bit of a token is predicted from the words before it, also those that tell words of one class apart."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from catchwork.llm import lm


def test_words_of_a_class_are_told_apart_by_the_words_before(spark):
    classes = {}
    for k in range(200):
        classes.setdefault(zlib.crc32(b"w%d" % k) >> (32 - lm.CLASS_BITS), []).append(f"w{k}")
    one, two, *_ = next(c for c in classes.values() if len(c) > 3)
    texts = [f"p {one} x", f"q {two} x"] * 300 + [f"p {two} x", f"q {one} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    assert got[0] > got[600] + 1 and got[1] > got[601] + 1


def test_paths_are_a_distribution(spark):
    words = {b"w%d" % k: float(1 + k % 9) for k in range(300)} | {b"": 50.0}
    reader = lm.Classes(lm.SLOTS, words, [3.0] * (1 << lm.CLASS_BITS))
    begin, nodes, bits = reader.code
    paths = [tuple(zip(nodes[a:b].tolist(), bits[a:b].tolist(), strict=True)) for a, b in zip(begin, begin[1:], strict=False)]
    assert len(paths) == len(words) + (1 << lm.CLASS_BITS) and len({frozenset(p) for p in paths}) == len(paths)
    assert max(nodes) < reader.widths[0]
    share = {}
    for node in nodes.tolist():
        share.setdefault(node, (node * 37 % 97 + 1) / 99)  # any share of ones at each node
    assert sum(np.prod([share[n] if b else 1 - share[n] for n, b in p]) for p in paths) == pytest.approx(1.0)
    texts = pa.array(["w1 w2", None, "other w7"])
    sizes = [len(paths[leaf]) for leaf in reader.read([[b"w1", b"w2"], [], [b"other", b"w7"]])[2]]
    assert sum(len(v) for _, _, v in reader.bits(texts)) == sum(sizes)


def test_tables_count_rows_by_weight(spark):
    reader = spark.sparkContext.broadcast(lm.Spelling(np.ones(256, np.int64), lm.SLOTS))
    once = lm.context_tables(spark.createDataFrame([("abc",), ("abc",), ("abc",), ("b",)], "text string"), reader)
    same = lm.context_tables(spark.createDataFrame([("abc", 3), ("b", 1)], "text string, weight long"), reader)
    assert all((a == b).all() for x, y in zip(once, same, strict=True) for a, b in zip(x, y, strict=True))


def test_columns_are_read_as_rows_are():
    texts = ["w1 w2", None, "", " \t\n", "Other\x0bW7 äÄ w1", "x\x1cy  w299\r\nw1 "]
    for words in (None, {b"w%d" % k: 1.0 for k in range(300)} | {b"": 5.0}):
        reader = lm.Classes(lm.SLOTS, words, [3.0] * (1 << lm.CLASS_BITS))
        flat, key, leaf, far = reader.read([lm.tokens((t or "").encode()) for t in texts])
        got = reader.read_column(pa.array(texts))
        assert got[0].to_pylist() == [w for w in flat if w] and got[3].tolist() == [len(lm.tokens((t or "").encode())) + 1 for t in texts]
        assert (got[1] == far).all() and (got[2] == key).all() and (got[4] == leaf).all() and got[5].to_pylist() == [flat[k] for k in far]


def test_one_worker_a_task_reads_the_lexicon(spark, monkeypatch):
    """Words with a path are told from the others by their counts, not by one more Python step before the spelling."""
    plans, keep = [], lm.checkpointed
    monkeypatch.setattr(lm, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    docs = spark.createDataFrame([(k, f"a b c{k % 5} d{k}") for k in range(50)], "doc_id long, text string")
    assert lm.score(docs).count() == 50 and [p.count("MapInArrow") for p in plans] == [1, 1]


def test_bits_come_with_their_places():
    """Training and counting get places in tables of zeros and ones at once; they are those of the slots."""
    texts = pa.array(["w1 w2 other", None, "w7 w7 w1"])
    words = {b"w%d" % k: float(1 + k) for k in range(300)} | {b"": 50.0}
    for reader, rows in ((lm.Classes(lm.SLOTS, words, [3.0] * (1 << lm.CLASS_BITS)), texts), (lm.Spelling(np.ones(256, np.int64), lm.SLOTS), pa.array([b"abc", b"", b"w\xc3\xa4"]))):
        slots, places = list(reader.bits(rows)), list(reader.bits(rows, placed=True))
        assert len(slots) == len(places) > 0
        for (o, s, v), (p, q, w) in zip(slots, places, strict=True):
            assert (o == p).all() and (v == w).all() and all((2 * a + v == b).all() for a, b in zip(s, q, strict=True))


def test_checksums_of_a_column():
    words = [b"", b"a", "\u00e4\u4f60".encode(), b"x" * 1000, b"", b"end"]
    for column, own in ((pa.array(words, pa.binary()), words), (pa.array(words, pa.binary()).slice(2, 3), words[2:5]), (pa.array([b"", b""], pa.binary()), [b"", b""]), (pa.array([], pa.binary()), [])):
        assert lm.checksums(column).tolist() == [zlib.crc32(w) for w in own]
