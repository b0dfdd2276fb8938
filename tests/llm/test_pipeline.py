"""The pipeline against brute force on the smallest documents."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_pipeline(spark, sf):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = sorted(i for i, t in docs.items() if not brute.op6(t)[5])
    roots = brute.components([brute.fingerprint(docs[i]) for i in kept])
    kept = sorted({kept[r] for r in roots})
    kept = [i for i, hit in zip(kept, brute.op1([docs[i] for i in kept], items), strict=True) if not hit[4]]
    assert sorted(got) == kept
    for i in kept:
        if not brute.op4(docs[i]):
            assert got[i]["decoded_sha256"] == brute.sha(docs[i])


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]
