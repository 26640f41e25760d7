import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm.components import _join, components
from plumbline.llm.line_runs import LineRuns, dedup_lines
from plumbline.llm.recompression import dedup_passages
from plumbline.llm.repeats import find_repeats
from plumbline.llm.simhash import keep_one, mark_links, near_duplicates
from plumbline.llm.suffix_dedup import SuffixMethod, blind_trie_order, dedup_substrings, suffix_order
from plumbline.session import shared_folder
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def awkward(spark):
    df, rows = fx.awkward_docs(spark)
    return df.persist(), rows


def _bytes(rows):
    return fx.order(fx.repeated_units(rows, 200, list, bytes))


def test_substrings_match_brute_force(awkward):
    df, rows = awkward
    got = dedup_substrings(df)
    assert fx.order((r.id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == _bytes(rows)
    assert all(fx.sha(bytes(r.kept)) == r.kept_sha256 for r in got.collect())


def test_crowded_anchors_give_the_same_answer(awkward):
    df, rows = awkward
    method = SuffixMethod()
    method.sorted_chunks = 1  # all but pairs are counted instead of sorted
    got = find_repeats(df, method, "doc_id", "text", False)
    assert fx.order((r.id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == _bytes(rows)


def test_long_texts_are_cut_into_pieces(awkward):
    df, rows = awkward
    got = find_repeats(df, SuffixMethod(piece=1000), "doc_id", "text", False)
    assert fx.order((r.id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == _bytes(rows)


def test_blind_trie_sorts():
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"\x00ab") for _ in range(12)) for _ in range(300)]
    assert [strings[i] for i in blind_trie_order(strings)] == sorted(strings)


def test_suffix_order_counts_common_bytes():
    draw = np.random.default_rng(1)
    text = draw.integers(0, 2, (200, 128)).astype(np.uint8)
    text[:, :110] = text[0, :110]
    group = draw.integers(0, 3, 200)
    order, common = suffix_order(group, text)
    keys = [(group[i], text[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for i in range(1, 200):
        a, b = text[order[i - 1]], text[order[i]]
        want = -1 if keys[i][0] != keys[i - 1][0] else int(np.argmax(a != b)) if (a != b).any() else 128
        assert common[i] == want


def test_passages_match_brute_force(awkward):
    df, rows = awkward
    got = dedup_passages(df)
    want = fx.repeated_units(rows, 35, bytes.split, b" ".join)
    assert fx.order((r.id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == fx.order(want)


def test_passages_with_periods(spark):
    draw = random.Random(3)
    rows = []
    for i in range(150):
        words = [draw.choice(["a", "b", "c", "dd"]) for _ in range(draw.choice([1, 2, 3, 5]))]
        text = (words * 200)[: draw.randint(0, 150)]
        for _ in range(draw.randint(0, 2)):
            text.insert(draw.randint(0, len(text)), draw.choice(["a", "x"]))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_passages(df, with_text=False)
    want = fx.repeated_units(rows, 35, bytes.split, b" ".join)
    assert fx.order((r.id, r.n_units, r.n_removed, r.kept_sha256) for r in got.collect()) == fx.order(want)


def test_lines_match_brute_force(awkward):
    df, rows = awkward
    for batches in (1, 5):
        got = dedup_lines(df, batches=batches).select(
            "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")), 256), "row.*"
        )
        assert fx.order(tuple(r)[:4] for r in got.collect()) == fx.order(fx.line_dedup(rows))
        assert got.columns[4:] == df.columns


def test_line_runs_are_compacted(spark):
    runs = LineRuns(spark, df_type(spark), fan_in=2)
    seen = {}
    for batch in range(5):
        lines = [(bytes([n]), batch * 100 + n) for n in range(batch, batch + 4)]
        runs.add(spark.createDataFrame(lines, "line binary, id long"))
        for line, i in lines:
            seen.setdefault(line, i)
        assert all(len(level) < 2 for level in runs.levels)
    assert {bytes(r.line): r["first"] for r in runs.known().collect()} == seen


def df_type(spark):
    return spark.range(1).schema["id"].dataType


def test_simhash_matches_brute_force(awkward):
    df, rows = awkward
    got = near_duplicates(df).select("id", F.lower(F.lpad(F.hex("mark"), 16, "0")), "component_id").collect()
    assert fx.order(tuple(r) for r in got) == fx.order(fx.component_of(rows))


def test_one_document_of_each_group_stays(awkward):
    df, rows = awkward
    kept = keep_one(df)
    assert kept.columns == df.columns
    groups = {c if c is not None else mark for _, mark, c in fx.component_of(rows)}
    assert kept.count() == len(groups)


def test_tiles_lose_no_link(spark):
    draw = np.random.default_rng(4)
    marks = draw.integers(-(2**63), 2**63, 400, dtype=np.int64)
    near = marks[:200] ^ (np.int64(1) << draw.integers(0, 63, 200))
    marks = np.unique(np.concatenate([marks, near, near ^ np.int64(6)]))
    links = mark_links(spark.createDataFrame([(int(m),) for m in marks], "mark long"), tile=64).collect()
    parent = {int(m): int(m) for m in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert 0 < np.bitwise_count(np.int64(r.a) ^ np.int64(r.b)) <= 3
        parent[root(r.a)] = root(r.b)
    for i, m in enumerate(marks):
        for other in marks[i + 1 :][np.bitwise_count(marks[i + 1 :].view(np.uint64) ^ m.view(np.uint64)) <= 3]:
            assert root(int(m)) == root(int(other))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)} | {199: 199, 200: 199}
    assert got == want


def test_components_settle_in_few_tables(spark):
    links = [(i, i + 1) for i in range(300)]
    before = set(Path(shared_folder(spark)).glob("plumbline-links-*"))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()}
    assert got == {i: 0 for i in range(301)}
    assert len(set(Path(shared_folder(spark)).glob("plumbline-links-*")) - before) == 2


def test_components_across_partitions(spark):
    draw = random.Random(5)
    links = [(draw.randrange(900), draw.randrange(900)) for _ in range(500)] + [(None, 3), (3, None)]
    links += [(1000, 1000 + draw.randrange(1, 400)) for _ in range(600)]
    want = fx.least_reachable([x for x in links if None not in x and x[0] != x[1]])
    many = spark.createDataFrame(links, "a long, b long").repartition(40)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")  # a task reads one file
    try:
        got = components(many).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(got) == len(want)
    assert {r.node: r.root for r in got} == want


def test_tasks_join_bounded_numbers_of_links(monkeypatch):
    monkeypatch.setattr("plumbline.llm.components.HELD", 8)
    links = [(i + 1, i) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
    made = list(_join(iter([batch, batch])))
    assert max(m.num_rows for m in made) < 8
    pairs = [(r["a"], r["b"]) for m in made for r in m.to_pylist()]
    assert all(a > b for a, b in pairs) and fx.least_reachable(pairs) == {i: 0 for i in range(41)}
    assert list(_join(iter([]))) == []


def test_empty_tables(spark):
    none = fx.no_docs(spark)
    assert dedup_substrings(none).count() == 0
    assert dedup_passages(none).count() == 0
    assert dedup_lines(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert keep_one(none).columns == none.columns


def test_finished_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("plumbline.llm.tables.run_folder", lambda _, purpose: f"{tmp_path}/{purpose}")
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d e y"), (3, None)], "doc_id long, text string")
    found = dedup_passages(docs, window=3)
    assert sorted((r.id, r.n_removed) for r in found.collect()) == [(1, 4), (2, 4), (3, 0)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["late", "looked"]
