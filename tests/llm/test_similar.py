"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from plumbline.llm import similar
from tests.llm import fixtures as fx


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    sets = [_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return {min(r[0] for r, g in zip(rows, group) if g == one) for one in set(group)}


def _copies(seed):
    draw = random.Random(seed)

    def prose(n):
        return [f"w{draw.randint(0, 900)}" for _ in range(n)]

    shared, texts = prose(40), ["", " \n", "one", "ONE", "two words", None]
    for n in (6, 9, 24, 60, 248, 700):
        base = prose(n)
        texts.append(" ".join(base))
        for changed in (1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(max(1, changed * n // 250)):
                copy[draw.randrange(n)] = "other"
            texts.append(" ".join(copy).upper() if changed == 2 else "  ".join(copy))
            texts.append(" ".join(copy[: n - changed * n // 60]))
    texts += [" ".join(prose(20) + shared + prose(20)) for _ in range(40)]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_stage_matches_brute_force(spark):
    for seed in (1, 2):
        rows = _copies(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
        assert sorted(got) == sorted(_kept(rows))


def test_stage_with_awkward_rows(spark):
    df, rows = fx.awkward_docs(spark)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    named = [r[:2] for r in rows if r[0] is not None]
    assert {r.doc_id for r in kept.collect()} - {None} == _kept(named)
    assert corpus_pipeline.near_duplicates(spark, fx.no_docs(spark), "").count() == 0


def test_sets_that_are_alike_share_a_first_shingle():
    draw = np.random.default_rng(3)
    classes = draw.integers(0, 9, similar.CELLS).astype(np.uint8)
    for _ in range(300):
        both = draw.integers(0, 2**63, draw.integers(1, 60)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, draw.integers(0, 2**63, draw.integers(0, 9)).astype(np.uint64)])) for _ in "ab")
        if similar.alike(a, b):
            assert set(similar.prefix(a, classes).tolist()) & set(similar.prefix(b, classes).tolist())
