"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest

from tidewatch.plans.lineage import stage

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, f in corpus_pipeline.STAGES:
        docs.append(stage(f(spark, docs[-1], SMALL)))
    return docs


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[:5])


def test_quality_keeps_good_documents(spark, steps):
    kept = {d for d, _ in rows(steps[1])}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    long = {d for d, t in rows(steps[0]) if len(brute.WORD.findall(t)) >= 50}
    good = [d for d in long if labels.get(d) == 1]
    bad = [d for d in long if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_one_of_each_group_stays(steps):
    want = sorted(d for d, _, _, kept in brute.near(rows(steps[1]), width=5) if kept)
    assert sorted(d for d, _ in rows(steps[2])) == want


def test_repeated_passages_go(steps):
    want = sorted((d, bytes(b for b, g in zip(s, gone) if not g).decode("utf-8", "ignore")) for d, s, gone in brute.covered([(d, t.encode()) for d, t in rows(steps[2])], bytes, 50))
    assert sorted(rows(steps[3])) == want


def test_mix_and_packing(steps):
    before, after = dict(rows(steps[3])), rows(steps[4])
    assert after and all(before[d] == t for d, t in after)
    pieces = steps[5].toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096 and (pieces.piece == 0).sum() == len(after)
