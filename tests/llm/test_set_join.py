"""The shingle join against brute force, by pivots alone and by blocks."""

import random

import numpy as np
import pytest

from plumbline.llm import set_join as sj
from tests.llm import fixtures as fx


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def _plain(rows):
    sets = [_shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return fx.order((r[0], len(s), least.get(g)) for r, s, g in zip(rows, sets, group))


def _copies(seed, many):
    """Texts with copies at distances around the limit, and a family of copies of copies."""
    draw = random.Random(seed)

    def prose(n):
        return [f"w{draw.randint(0, 400)}" for _ in range(n)]

    def changed(words, k):
        words = list(words)
        for _ in range(k):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
        return words

    shared, texts = prose(60), ["", None, " \t\n", "one", "ONE", "two words", "two  WORDS", "a b c"]
    for n in (10, 11, 12, 13, 14, 21, 22, 40, 90, 300, 900):
        base = prose(n)
        texts.append(" ".join(base))
        texts += [" ".join(base[: n - k]) for k in (1, 2, n // 11, n // 10, n // 9)]
        texts += [" ".join(changed(base, k)) for k in range(1, 2 + n // 20)][:12]
    family = prose(200)
    for _ in range(many):
        texts.append(" ".join(family))
        family = changed(family, 1) if draw.random() < 0.7 else changed(prose(0) or family, 4)
    texts += [" ".join(prose(15) + shared + prose(15)) for _ in range(20)]
    draw.shuffle(texts)
    return list(enumerate(texts))


def _got(found):
    return fx.order(tuple(r) for r in found.select("id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("seed, pivots, block", [(1, 3, 512), (2, 1, 4)])
def test_against_brute_force(spark, monkeypatch, seed, pivots, block):
    monkeypatch.setattr(sj, "PIVOTS", pivots)
    monkeypatch.setattr(sj, "BLOCK", block)
    rows = _copies(seed, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(sj.join_sets(df)) == _plain(rows)


def test_awkward_rows(spark):
    df, rows = fx.awkward_docs(spark)
    assert _got(sj.join_sets(df)) == _plain(rows)
    assert sj.join_sets(fx.no_docs(spark)).count() == 0


def test_alike_sets_share_a_tile_and_pass_the_bitmaps():
    draw = np.random.default_rng(5)
    seen = 0
    for _ in range(4000):
        both = draw.integers(0, 2**63, draw.integers(5, 400)).astype(np.uint64) * np.uint64(2)
        apart = int(len(both) * 0.12) + 2
        a, b = (np.unique(np.concatenate([both, draw.integers(0, 2**63, draw.integers(0, apart)).astype(np.uint64)])) for _ in "ab")
        if sj.alike(a, b):
            seen += 1
            if len(a) >= sj.LEAST_SIZE and not np.array_equal(a, b):
                assert set(sj.tile_keys(a).tolist()) & set(sj.tile_keys(b).tolist())
                x, y = (np.frombuffer(sj.bitmap(s), np.uint64)[None, :] for s in (a, b))
                words = min(x.shape[1], y.shape[1])
                assert np.bitwise_count(sj.fold(x, words) ^ sj.fold(y, words)).sum() <= sj.most_apart(len(a), len(b))
    assert seen > 500


def test_sizes_under_the_least_are_alike_only_if_equal():
    for a in range(1, sj.LEAST_SIZE):
        assert sj.DOWN * a < sj.UP * (a + 1)
