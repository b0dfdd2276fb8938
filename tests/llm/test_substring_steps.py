"""Only chunks that can be repeats reach the aggregate that sorts them by place."""

from catchwork.llm import substring


def test_chunks_that_occur_once_are_never_sorted(spark, monkeypatch):
    seen, keep = [], substring.chunks
    monkeypatch.setattr(substring, "chunks", lambda *a, **k: seen.append(keep(*a, **k)) or seen[-1])
    passage = " ".join(f"shared{k}" for k in range(40))
    texts = [" ".join(f"own{d}x{k * k * 7919 % 10007}" for k in range(300)) for d in range(20)]
    docs = spark.createDataFrame([(d, f"{t} {passage} {t[::-1]}" if d < 2 else t) for d, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["stays"] for r in substring.repeats(docs).collect()}
    total = sum(len(substring.chunk_ends(t.encode())) for t in texts)
    assert got == {0: True, 1: False} and seen and all(0 < d.count() < total / 10 for d in seen)
