"""Leaks are searched for in far fewer directions than passages, and paraphrases are found as by looking at all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import PASSAGE, STRIDE, Space, cut_items, find_leaks, plain_words, spaces


def _tables(spark):
    draw = random.Random(14)
    vocabulary = [f"w{i}" for i in range(1500)] + ["the", "of", "and", "to", "in"] * 150

    def prose(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    items = [prose(draw.choice([8, 16, 48, 96, 140, 190])) for _ in range(90)]
    texts = []
    for i, words in enumerate(items):
        kept = [w if draw.random() < draw.choice([0.7, 0.8, 0.9]) else draw.choice(vocabulary) for w in words[:-6]]
        texts.append((i, " ".join(prose(draw.randint(0, 60)) + kept + words[-6:] + prose(draw.randint(0, 60)))))
    texts += [(i, " ".join(prose(100))) for i in range(90, 120)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    return bench, texts, docs, spark.createDataFrame(bench, "item_id long, text string")


def _by_all_pairs(bench, texts):
    """Every passage of every document against every one of the benchmark, by the common subsequence alone."""
    passages = cut_items(bench)
    space, found = Space(passages), set()
    for doc, text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        words = plain_words(np.array([0, len(data)]), data)[0]
        for at in range(0, max(1, len(words) - STRIDE), STRIDE):
            for p in passages:
                if (doc, p.item) not in found and space._verify(words, 0, len(words), at, p):
                    found.add((doc, p.item))
    return found


def test_paraphrases_are_found_in_few_directions(spark):
    bench, texts, docs, items = _tables(spark)
    want = _by_all_pairs(bench, texts)
    got = {(r.id, r.item) for r in find_leaks(docs, items).collect()}
    assert len(want) >= 80 and got <= want
    assert len(got) / len(want) >= 0.95
    (_, sent), *_ = spaces(docs, items)
    space = sent.value
    rank = np.linalg.matrix_rank(space.sought)
    assert len(space.passages) >= 300 and rank <= len(space.passages) / 2


def test_directions_follow_the_documents(spark):
    _, _, docs, items = _tables(spark)
    (_, one), *_ = spaces(docs, items)
    (_, other), *_ = spaces(docs.selectExpr("doc_id", "concat_ws(' ', reverse(split(text, ' '))) AS text").where("doc_id >= 90"), items)
    bases = [np.linalg.qr(s.value.latent[:-1] / s.value.weight[:, None])[0] for s in (one, other)]
    # sines of the angles between the two spaces: other documents, other directions
    assert np.linalg.svd(bases[0].T @ bases[1], compute_uv=False).min() < 0.5
    for found in (one, other):
        assert found.value.latent.shape[1] * 2 < len(found.value.passages)


def test_no_documents_or_only_unknown_words(spark):
    _, _, _, items = _tables(spark)
    none = spark.createDataFrame([(1, None), (2, ""), (3, "zz yy xx vv uu tt ss")], "doc_id long, text string")
    assert find_leaks(none, items).count() == 0 and find_leaks(none.limit(0), items).count() == 0


class Sent:
    def __init__(self, value):
        self.value = value


def test_directions_are_fitted_on_every_passage_of_every_document(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(24))
    texts = [(i, f"w{i % 24} filler {'x ' * (i % 5)}w{i % 7}") for i in range(4500)]
    texts += [(4500, " ".join(f"w{i // PASSAGE % 24}" for i in range(100 * PASSAGE + 5))), (4501, "x y z"), (4502, None), (4503, "W1 w1")]
    taken = []

    def spy(passages, weight, directions=decontaminate.DIRECTIONS):
        for r in passages.collect():
            parts = np.split(terms := np.frombuffer(r.terms, np.int32), np.flatnonzero(terms < 0) + 1)
            taken.extend(tuple(sorted(p[p >= 0].tolist())) for p in parts if (p >= 0).any())
        return np.eye(len(weight))

    monkeypatch.setattr(decontaminate, "latent_directions", spy)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    (_, sent), *_ = spaces(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    number = {f"w{i}": n for i, n in enumerate(sent.value.numbers(plain_words(np.array([0, len(item)]), np.frombuffer(item.encode(), np.uint8))[0]).tolist())}
    want = [tuple(sorted(number.values()))]
    for _, text in texts:
        words = (text or "").lower().split()
        cut = [[number[w] for w in words[i : i + PASSAGE] if w in number] for i in range(0, len(words), PASSAGE)]
        want += [tuple(sorted(p)) for p in cut if p]
    assert sorted(taken) == sorted(want)


@pytest.mark.parametrize("cells", [1 << 24, 700])
def test_bands_of_products_add_up(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "BAND_CELLS", cells)
    monkeypatch.setattr(decontaminate, "HELD_TERMS", 60)
    draw = np.random.default_rng(4)
    passages = [draw.integers(0, 50, draw.integers(1, 25)).astype(np.int32) for _ in range(40)]
    weight, z, times = draw.random(50) + 0.5, draw.standard_normal((50, 6)), draw.random(8)
    a = np.zeros((40, 50))
    for i, t in enumerate(passages):
        np.add.at(a[i], t, weight[t])
        a[i] *= np.sqrt(times[i // 5] / (weight[t] ** 2).sum())
    rows = [b"".join(np.append(t, -1).astype(np.int32).tobytes() for t in passages[i : i + 5]) for i in range(0, 40, 5)]
    rows[3] = rows[3][:-4]  # the last -1 of a row may be missing
    batches = [pa.record_batch([pa.array(rows[i : i + 3], pa.binary()), pa.array(times[i : i + 3])], ["terms", "times"]) for i in (0, 3, 6)]
    (found,) = decontaminate._normal_product(Sent(z), Sent(weight))(iter([batches[0][:0], *batches]))
    got = np.concatenate([np.frombuffer(p, np.float32).reshape(-1, 6) for p in found.column("part").to_pylist()])
    assert np.allclose(got, a.T @ (a @ z), atol=1e-4)
