"""The manifest against a plain tree, in blocks small enough that rounds nest."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from tests.llm import fixtures as fx


def _field(value):
    if value is None:
        return b"-"
    data = str(value).encode()
    return str(len(data)).encode() + b":" + data


def _leaf(row, text):
    return fx.sha(b"".join(_field(v) for v in (*row[:1], row[3], row[2], row[4], text)))


def _tree(nodes):
    """(root, siblings of each node as (left, right) per level)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        made, below = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for i in range(len(run)):
                for x in under[at + i]:
                    paths[x].append(("".join(run[:i]), "".join(run[i + 1 :])))
            made.append(fx.sha("".join(run).encode()))
            below.append([x for u in under[at : at + 3] for x in u])
        nodes, under = made, below
    return (nodes[0] if nodes else None), paths


def _plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees.append((members, *_tree([_leaf(r, r[1]) for r in members])))
    root, tops = _tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, tops):
        for r, path in zip(members, paths):
            path = path + top
            hurt = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = _leaf(r, r[1].replace("\n", "") if hurt else r[1])
            for left, right in path:
                node = fx.sha((left + node + right).encode())
            proof = fx.sha("".join(left + right for left, right in path).encode())
            out.append((r[0], _leaf(r, r[1]), subroot, root, proof, node, node == root))
    return fx.order(out)


def _query(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op12_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_awkward_rows(spark, tmp_path, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FAN**digits)
    df, rows = fx.awkward_docs(spark)
    got = [tuple(r) for r in _query(spark, df, tmp_path).collect()]
    assert fx.order(got) == _plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_source_one_row_and_none(spark, tmp_path):
    row = (7, "a\nb", "en", "only", 3, None, None, None, None)
    got = [tuple(r) for r in _query(spark, spark.createDataFrame([row], fx.SCHEMA), tmp_path / "one").collect()]
    assert got == _plain([row]) and got[0][1] == got[0][2] == got[0][3]
    assert _query(spark, fx.no_docs(spark), tmp_path / "none").count() == 0


def test_hot_source_and_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    draw = random.Random(4)
    rows = [(i, f"t{i}\n", "en", "hot" if i % 3 else f"s{draw.randint(0, 40)}", 2, None, None, None, None) for i in range(300)]
    rows += [(5, "same", None, "hot", None, None, None, None, None)] * 200
    df = spark.createDataFrame(rows, fx.SCHEMA).repartition(7)
    assert fx.order(tuple(r) for r in _query(spark, df, tmp_path).collect()) == _plain(rows)


def test_paths_lead_to_the_root(spark):
    df, rows = fx.awkward_docs(spark)
    found = merkle.manifest(df).select("*", merkle.folded(F.col("leaf"), F.col("path")).alias("again"))
    assert found.where("again <> root").count() == 0 and found.count() == len(rows)
