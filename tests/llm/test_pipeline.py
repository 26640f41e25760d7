"""The pipeline against a plain version of each stage, on the smallest given tables."""

import random

import pytest

import corpus_pipeline
from plumbline.llm import quality
from plumbline.llm.tables import stash
from tests.llm import fixtures as fx

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage, as the driver runs them."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stash(stage(spark, docs, FOLDER), "test-stage")
        out.append((name, docs, made))
        docs = made
    return {name: (before.collect(), after.collect(), before.columns, after.columns) for name, before, after in out}


def test_columns(steps):
    for name, (_, _, before, after) in steps.items():
        assert after == before if name != "mix" else after[: len(before)] == before


def test_quality_keeps_what_scores_half(steps, spark):
    before, after, *_ = steps["quality"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in before if model.score(quality.indicators((r.text or "").encode())) >= 0.5}
    assert {r.doc_id for r in after} == good


def test_lines(steps):
    before, after, *_ = steps["lines"]
    want = {i: digest for i, _, _, digest in fx.line_dedup([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: fx.sha((r.text or "").encode()) for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(steps):
    before, after, *_ = steps["near_duplicates"]
    want = {c for _, _, c in fx.component_of([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_leaks(steps, spark):
    before, after, *_ = steps["leaks"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(" ".join(t.split()) in " ".join((r.text or "").split()) for t in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert leaked <= gone and len(gone - leaked) <= 0.02 * len(before)


def test_mix(steps):
    before, after, *_ = steps["mix"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    took, target = dict.fromkeys(sizes, 0), {}
    for r in after:
        took[r.source] += r.taken
        target[r.source] = r.target
        assert 0 < r.taken <= 2 * r.size
    for s in target:
        mine = [len((r.text or "").encode().split()) for r in before if r.source == s]
        assert took[s] == fx.closest_below(mine, round(target[s]))


def test_run_gives_the_last_stage(steps, spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps["mix"][1]))


def test_near_duplicates_links_by_fingerprints_and_by_sets(spark):
    """Copies within 3 bits go though their sets are alike by less than 0.8, and copies of like sets beyond 3 bits."""
    draw = random.Random(819)
    words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    text, near = " ".join(words), " ".join("x" if i % 19 == 5 else w for i, w in enumerate(words))
    assert (fx.fingerprint(text) ^ fx.fingerprint(near)).bit_count() <= 3
    ends = (f"{text} y{i} z{i}" for i in range(100))
    far = next(t for t in ends if (fx.fingerprint(text) ^ fx.fingerprint(t)).bit_count() > 3)
    for other in (near, far):
        docs = spark.createDataFrame([(1, text), (2, other), (3, "quite another text")], "doc_id long, text string")
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == {1, 3}
