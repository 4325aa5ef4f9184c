import math

import numpy as np
from helpers import given

from pulsegrid.llm.multi_index import MultiIndex, search


def brute(rows, ask=lambda i: i % 100 == 0, k=10):
    good = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None), key=lambda r: r[0]):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(v)
    good = {i: min(v) for i, v in good.items()}
    out = {}
    for q, point in good.items():
        if ask(q):
            near = sorted((math.dist(point, v), i) for i, v in good.items() if i != q and len(v) == len(point))[:k]
            out[q] = near
    return out


def test_recall_on_the_given_vectors(spark):
    rows = [(i, v) for i, v in given("embeddings", "vec_id, embedding")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in search(spark, table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, len(near) + 1))
        points = dict(rows)
        for _, i, score in own:
            assert abs(score - math.dist(points[q], points[i])) < 1e-9
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in near})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_edge_rows_ties_and_a_hot_vector(spark):
    random = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 400)]
    rows += [(i, random.standard_normal(3).tolist()) for i in range(400, 700)]
    rows += [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (500, [9.0, 9.0, 9.0]), (800, [1.0, 1.0]), (900, [7.0]), (901, [8.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cell string, v int")
    got = {}
    for r in search(spark, table, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [i for _, i in near] for q, near in brute(rows).items()}
    assert got[100] == list(range(101, 111)) == want[100]
    assert got[900] == [901] and 800 not in got and 1 not in got
    assert got[200] == want[200]
    assert set(got) == {q for q, near in want.items() if near}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(spark, empty).count() == 0


def test_cells_are_visited_by_summed_distance():
    random = np.random.default_rng(4)
    one, two = random.standard_normal((9, 2)), random.standard_normal((7, 3))
    index = MultiIndex(one, two, np.ones(63, np.int64))
    query = random.standard_normal(5)
    sums = [((query[:2] - one[c // 7]) ** 2).sum() + ((query[2:] - two[c % 7]) ** 2).sum() for c in index.visit(query)]
    assert len(sums) == 63 and np.all(np.diff(sums) >= -1e-12)
