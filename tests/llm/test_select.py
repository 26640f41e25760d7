import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import neighbours, quality
from plumbline.llm.decontaminate import common_length, cut_items, drop_leaks, find_leaks, latent_directions, _masks
from plumbline.llm.license_scan import scan_licenses
from plumbline.llm.mixing import fit, mix_sources, take_mix
from plumbline.llm.url_reputation import judge_urls
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def awkward(spark):
    df, rows = fx.awkward_docs(spark)
    return df.persist(), rows


def test_license_phrases(awkward):
    df, rows = awkward
    got = scan_licenses(df)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for r in rows:
        words, places, labels = fx.license_words(r[1]), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        want.append((r[0], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    found = got.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert fx.order(tuple(r) for r in found) == fx.order(want)
    apache = got.where("contains(labels, 'apache-2.0')").select("row.text", "score").collect()
    assert [tuple(r) for r in apache] == [("Licensed under the Apache License, Version 2.0.", 1.0)]
    assert scan_licenses(fx.no_docs(df.sparkSession)).count() == 0


def test_a_notice_with_a_missing_word_counts_by_its_share(spark):
    df = spark.createDataFrame([("so licensed under the apache license version 3 0 it is",), ("apache mit license",)], "text string")
    got = {r.text: (r.labels, r.score) for r in scan_licenses(df).select("row.text", "labels", "score").collect()}
    assert got["so licensed under the apache license version 3 0 it is"] == ("apache-2.0", 7 / 8)
    assert got["apache mit license"] == ("", 0.0)


def test_urls(spark):
    urls = [
        "https://A.Example.com/en/x?q", "http://www.example.com/en/", "http://deep.www.example.com/en/1#f", "http://example.com/fr",
        "http://x.net/es/1", "http://x.net/de/1", "http://x.net/fr/1", "http://y.org/en", "http://com/", "http://z.com", "http://z.com?a/",
        None, "", "no scheme/en/", "://", "ftp://u:p@host.com:80/p", "a://b://c/d", "http://notexample.com/en/",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.id: r for r in judge_urls(df).collect()}
    want = [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"),
        ("deep.www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/fr", "com/"), ("x.net", "/es/1", "net/es/"),
        ("x.net", "/de/1", None), ("x.net", "/fr/1", "net/fr/"), ("y.org", "/en", None), ("com", "/", "com/"), ("z.com", "", None),
        ("z.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("u:p@host.com:80", "/p", None),
        ("b:", "//c/d", None), ("notexample.com", "/en/", "com/"),
    ]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    assert all(got[i].verdict == ("block" if r in ("example.com/en/", "net/es/", "net/fr/") else "allow")
               for i, (_, _, r) in enumerate(want) if r)
    assert judge_urls(df.limit(0)).count() == 0


def test_reputation_follows_the_labels(spark):
    rows = [(i, f"http://{h}.site.org/{i}", bad) for i, (h, bad) in
            enumerate([("good", False)] * 60 + [("bad", True)] * 60 + [("few", True)] + [("new", None)])]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.host: r.verdict for r in judge_urls(df, rules=(), bad_col="bad").collect()}
    assert got == {"good.site.org": "allow", "bad.site.org": "block", "few.site.org": "allow", "new.site.org": "allow"}


def test_mix_meets_targets(awkward):
    df, rows = awkward
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
    took = dict.fromkeys(names, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken == r.copies * r["size"] and r.copies <= 2
        took[r.source] += r.taken
    for s in names:
        mine = [len((r[1] or "").encode().split()) for r in rows if r[3] == s]
        assert took[s] == fx.closest_below(mine, round(target[s]))
    again = mix_sources(df.repartition(3)).collect()
    assert fx.order(tuple(r) for r in again) == fx.order(tuple(r) for r in got)
    kept = take_mix(df)
    assert kept.columns[-4:] == ["size", "source_size", "target", "taken"] and len(set(kept.columns)) == len(kept.columns)
    assert kept.agg(F.sum("taken")).first()[0] == sum(took.values())
    assert mix_sources(fx.no_docs(df.sparkSession)).count() == 0


def test_subset_sum_is_the_best_from_below():
    draw = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted(draw.sample(range(1, 30), 4)))
        counts = np.array([draw.randint(0, 3) for _ in lengths])
        budget = draw.randint(0, 80)
        taken = fit(lengths, counts, budget)
        sums = [sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])]
        assert (taken <= counts).all() and (taken * lengths).sum() == max(s for s in sums if s <= budget)


def test_large_budgets_are_cut_first():
    lengths, counts = np.array([3, 50, 70_001]), np.array([40, 4000, 90])
    taken = fit(lengths, counts, 5_000_000)
    assert (taken <= counts).all() and 5_000_000 - (taken * lengths).sum() <= 2


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    score = quality.scorer(spark, model)
    known = docs.join(labels, "doc_id").where(quality.held_out("doc_id"))
    rows = known.select("doc_id", "quality", (score(F.col("text")) >= 0.5).cast("int").alias("said")).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.quality == r.said for r in rows) / len(rows) >= 0.95


def test_quality_with_awkward_rows(spark, awkward):
    df, _ = awkward
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (None, 1), (900, 0)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0)):
        model = quality.train(df, marks)
        scores = df.select(quality.scorer(spark, model)(F.coalesce("text", F.lit(""))).alias("s")).collect()
        assert all(0 <= r.s <= 1 for r in scores)
        assert quality.keep_good(df, model).columns == df.columns


def test_dual_descent_separates():
    draw = np.random.default_rng(6)
    rows = [np.unique(draw.integers(0, 50, 12) + 40 * (i % 2)).astype(np.uint32) for i in range(200)]
    good = np.arange(200) % 2 == 1
    ratio = quality.log_count_ratios(rows, good)
    weight, bias = quality.dual_coordinate_descent(rows, good, ratio)
    model = quality.Model(ratio, weight, bias, 1.0, 0.0)
    assert np.mean([(model.margin(r) > 0) == g for r, g in zip(rows, good)]) > 0.95


def test_leaks_are_found_and_clean_documents_left(spark):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 300
    item = [" ".join(draw.choice(vocabulary) for _ in range(n)) for n in (16, 40, 60, 24, 3)]
    bench = spark.createDataFrame([*enumerate(item), (9, None), (1, item[1])], "item_id long, text string")

    def prose(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    part = item[1].split()
    changed = " ".join("other" if i % 6 == 2 and i < 30 else w for i, w in enumerate(part))
    docs = [
        (0, prose(300)), (1, prose(50) + ". " + item[0].upper() + "! " + prose(70)), (2, item[2]), (3, changed + " " + prose(9)),
        (4, None), (5, ""), (6, prose(200) + " " + " ".join(item[3].split()[:6])), (7, prose(20000) + " " + item[3]), (8, item[4]),
    ] + [(i, prose(60)) for i in range(9, 60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, th int").repartition(4)
    got = {(r.id, r.item) for r in find_leaks(df, bench).collect()}
    assert got == {(1, 0), (2, 2), (3, 1), (7, 3)}
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {1, 2, 3, 7}
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0


def test_common_subsequence():
    draw = random.Random(8)
    for _ in range(100):
        a, b = ([draw.randint(1, 5) for _ in range(draw.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert common_length(_masks(np.array(a)), len(a), b) == table[-1][-1]


def test_directions_are_those_of_the_svd(spark):
    draw = np.random.default_rng(9)
    terms = [np.sort(draw.integers(0, 60, 15)).astype(np.int32) for _ in range(30)]
    weight = draw.random(60) + 0.5
    rows = spark.createDataFrame([(t.tobytes(),) for t in terms], "terms binary").repartition(3)
    found = latent_directions(rows, weight, 60)
    a = np.zeros((30, 60))
    for i, t in enumerate(terms):
        np.add.at(a[i], t, weight[t])
        a[i] /= np.sqrt((weight[t] ** 2).sum())
    assert np.allclose(a @ found @ found.T, a, atol=1e-4)
    assert len(cut_items([(1, "a b c d"), (2, " ".join(map(str, range(50))))])) == 3


def _true(rows, queries, k):
    vectors = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in queries:
        near = sorted((-float(neighbours.cosine(vectors[q], vectors[i][None])[0]), i) for i in vectors if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours_of_awkward_vectors(spark):
    draw = np.random.default_rng(10)
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(60)]
    rows += [(i, [1.0] * 8) for i in range(60, 90)] + [(90, [2.0] * 8), (91, [1e-200] * 8), (92, [-1e200] * 8)]
    odd = [(100, None), (101, [0.0] * 8), (102, [None] + [1.0] * 7), (103, [float("nan")] * 8), (104, [float("inf")] * 8), (None, [1.0] * 8)]
    odd += [(106, [1.0, 2.0]), (107, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd + rows[:2]], "vec_id long, embedding array<double>, id int")
    got = neighbours.search(df, df.where("vec_id % 5 = 0"))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
        assert r.rank == len(found[r.query_id])
    assert found == _true(rows, [i for i, _ in rows if i % 5 == 0], 5)
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id IN (0, 5)")
    assert {(r.query_id, r.id) for r in neighbours.search(few, few).collect()} == {(0, 5), (5, 0)}


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = _true(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = neighbours.search(df, df.where("vec_id % 50 = 0")).collect()
    assert sum(r.id in want[r.query_id] for r in got) / sum(map(len, want.values())) >= 0.9


def test_parts_are_balanced():
    draw = np.random.default_rng(11)
    centres = draw.standard_normal((4, 16)) * 5
    points = neighbours.unit(np.concatenate([c + draw.standard_normal((50, 16)) for c in centres]))
    part = neighbours.balanced_parts(neighbours.nearest(points, points, 8), 4)
    assert np.bincount(part).tolist() == [50] * 4
