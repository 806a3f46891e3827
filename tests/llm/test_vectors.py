"""Nearest neighbours and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from rollcall.llm import ann, vecdedup
from rollcall.llm.components import components

ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, None] + [0.0] * 6), (9005, [float("nan")] + [1.0] * 7),
       (9006, [float("inf")] + [1.0] * 7), (9007, [1.0, 2.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, rep int")


def clustered(n=400, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    return [(i, (centres[i % 25] + 0.35 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_nearest(spark):
    rows = clustered() + [(1000 + i, clustered()[7][1]) for i in range(30)]
    asked = [rows[0], rows[7], rows[410], (5000, rows[3][1])]
    got = ann.nearest(table(spark, asked + ODD), table(spark, rows + ODD)).collect()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hit = 0
    for name, v in asked:
        mine = sorted((r for r in got if r["query_id"] == name), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        d[ids == name] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        where = {i: k for k, i in enumerate(ids.tolist())}
        assert all(r["score"] == d[where[r["vec_id"]]] for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit += len(set(want.tolist()) & {r["vec_id"] for r in mine})
    assert hit >= 36
    assert [r["vec_id"] for r in got if r["query_id"] == 9007] == []


def test_few_rows_are_all_found(spark):
    rows = clustered(6)
    got = ann.nearest(table(spark, rows), table(spark, rows)).collect()
    assert len(got) == 30
    none = table(spark, rows).limit(0)
    assert ann.nearest(none, table(spark, rows)).count() == ann.nearest(table(spark, rows), none).count() == 0


def test_hot_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 20)
    rows = clustered(200) + [(1000 + i, [1.0] * 8) for i in range(100)]
    got = [r for r in ann.nearest(table(spark, rows[200:201]), table(spark, rows)).collect()]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1001, 1011))


@pytest.mark.parametrize("rows_per_task", [4096, 40])
def test_near_vectors(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(vecdedup, "ROWS", rows_per_task)
    rows = clustered() + [(1000 + i, clustered()[7][1]) for i in range(30)] + [(2000, [2 * x for x in clustered()[9][1]])]
    got = {r["vec_id"]: r for r in vecdedup.near_vectors(table(spark, rows + ODD + [(None, rows[0][1])])).collect()}
    x, ids = np.array([v for _, v in rows]), [i for i, _ in rows]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero((unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool))
    assert len(a) > 2000
    label = vecdedup.connect(len(x), a, b)
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == (a == k).sum() and got[i]["component_id"] == ids[label[k]]
        assert got[i]["kept"] == (i == ids[label[k]])
    for i in [i for i, _ in ODD]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0 and got[None]["kept"]
    assert vecdedup.near_vectors(table(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = np.array([e for e in edges if e[0] is not None and e[0] != e[1]])
    label = vecdedup.connect(1100, real[:, 0], real[:, 1])
    assert got == {int(n): int(label[n]) for n in np.unique(real)}
