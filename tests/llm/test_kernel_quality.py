import zlib

import numpy as np
from helpers import docs, given, long_text

from pulsegrid.llm import kernel_quality as m


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_on_the_given_documents(spark):
    rows, labels = given("documents", "doc_id, text"), given("labels", "doc_id, quality")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.quality(spark, frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == held_out(d) for d, r in got.items())
    known = [(q, got[d]) for d, q in labels if d in got and held_out(d)]
    assert np.mean([r["predicted"] == q for q, r in known]) >= 0.9
    # Labels of held-out documents are not used.
    turned = [(d, 1 - q if held_out(d) else q) for d, q in labels]
    again = {r["doc_id"]: r for r in m.quality(spark, frame, spark.createDataFrame(turned, "doc_id long, quality int")).collect()}
    assert all(abs(again[d]["score"] - r["score"]) < 1e-9 for d, r in got.items())


def test_sums_of_partitions_are_the_normal_equations(spark):
    rows = given("documents", "doc_id, text")
    labels = {d: q for d, q in given("labels", "doc_id, quality")}
    frame = spark.createDataFrame([(d, zlib.crc32(str(d).encode()) % 4, t) for d, t in rows], "doc_id long, fold int, text string")
    stats = frame.repartition(5).mapInArrow(m._measured, "doc_id long, fold int, stats array<float>")
    fitted = m.fit(spark, stats, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), cosines=64)
    x = np.array([m.statistics(t) for _, t in rows]).astype(np.float32).astype(float)
    to_cosines = m.CosineMap(x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0), 64)
    mine = [n for n, (d, _) in enumerate(rows) if d in labels and not held_out(d)]
    z, y = to_cosines(x[mine]), np.array([labels[rows[n][0]] for n in mine], float)
    ridge = np.diag([1e-9] + [m.RIDGE] * 64) * len(mine)
    want = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert np.allclose(z @ want, z @ fitted.weights, atol=1e-5)


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, len(m.STATISTICS)))
    z = m.CosineMap(np.zeros(x.shape[1]), np.ones(x.shape[1]), 20_000)(x)[:, 1:]
    cut = np.clip(x, -m.FAR, m.FAR)
    apart = ((cut[:, None] - cut[None]) ** 2).sum(-1) / (m.WIDTH**2 * x.shape[1])
    assert np.abs(z @ z.T - np.exp(-apart / 2)).max() < 0.05


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = rng.integers(1, 12)
        weight = rng.integers(1, 5, n).astype(float)
        total = weight * rng.random(n)
        got = m.isotonic(weight, total)
        # Max-min formula over all blocks around each place.
        want = [max(min(total[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_edge_rows(spark):
    texts = [None, "", "A plain sentence that says something.", "A plain sentence that says something.", long_text(), "!!! ###", "x" * 3_000_000, "\x00", "One more."]
    ids = [1, 2, 3, 3, 4, 5, 6, 7, None]
    labels = spark.createDataFrame([(3, 1, "z"), (3, 0, "z"), (5, 0, "z"), (None, 1, "z"), (4, None, "z"), (99, 1, "z")], "doc_id long, quality int, fold string")
    got = m.quality(spark, docs(spark, texts, ids=ids), labels).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(ids, key=str)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[3]) == 1 and all(0 <= s <= 1 for own in by.values() for s in own)
    assert by[1] == by[2]
    none = m.quality(spark, docs(spark, texts, ids=ids), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = spark.createDataFrame([(d, 1) for d in range(9)], "doc_id long, quality int")
    assert {r["predicted"] for r in m.quality(spark, docs(spark, texts, ids=ids), ones).collect()} == {1}
    assert m.quality(spark, docs(spark, []), labels).count() == 0
