import random

import numpy as np
from helpers import docs, given, long_text

from pulsegrid.llm.latent_decontamination import (
    WEIGHT,
    common_order,
    contaminated,
    latent_basis,
    least_product,
    without_leaks,
    words_of,
)


def plain_common_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_order_matches_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 70))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 150))]
        assert common_order(a, b) == plain_common_order(a, b)


def test_finds_every_exact_passage_of_the_given_documents(spark):
    rows, items = given("documents", "doc_id, text"), given("benchmark", "item_id, text")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark, table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    exact = set()
    for d, t in rows:
        own = b" ".join(words_of(t))
        exact |= {(d, i) for i, x in items if b" ".join(words_of(x)) in own}
    assert exact and exact <= got


def items_and_texts():
    rng = random.Random(7)
    vocabulary = [f"term{n}" for n in range(4000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice((18, 40, 60, 150)))) for _ in range(25)]
    filler = lambda n: " ".join(rng.choices(vocabulary, k=n))
    copies = [f"{filler(300)} {x} {filler(200)}" for x in items]
    loose = []
    for x in items:
        words = x.split()
        for at in rng.sample(range(len(words)), len(words) // 6):
            words[at] = "changed"
        loose.append(f"{filler(100)} {' '.join(words)} {filler(90)}")
    return items, copies, loose, [filler(500) for _ in range(30)]


def test_copies_and_paraphrases_are_found_and_clean_texts_left(spark):
    items, copies, loose, clean = items_and_texts()
    table = docs(spark, copies + loose + clean)
    bench = spark.createDataFrame([(n, x, "t", 3) for n, x in enumerate(items)], "item_id long, text string, words string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark, table, bench).collect()}
    assert got == {(n, n) for n in range(25)} | {(25 + n, n) for n in range(25)}
    kept = without_leaks(spark, table, bench)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(50, 80))


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [None, "", item, item, item, long_text() + " " + item, "one two"]
    table = docs(spark, texts, ids=[1, 2, 3, 3, None, 5, 6])
    bench = spark.createDataFrame([(9, item), (9, item), (None, item), (8, None), (7, ""), (6, "one two")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["ordered"]) for r in contaminated(spark, table, bench).collect())
    assert got == [(3, 9, 1.0), (5, 9, 1.0)]
    assert sorted((r["doc_id"] for r in without_leaks(spark, table, bench).collect()), key=str) == [1, 2, 6, None]
    assert contaminated(spark, table, bench.limit(0)).count() == 0
    assert contaminated(spark, docs(spark, []), bench).count() == 0


def test_basis_spans_the_passages(spark):
    rng = np.random.default_rng(2)
    lists = [[f"v{i}".encode() for i in rng.choice(60, 20)] for _ in range(12)]
    table = spark.createDataFrame([(n, 0, own) for n, own in enumerate(lists)], "item_id long, n long, words array<binary>")
    index = {w: n for n, w in enumerate(sorted({w for own in lists for w in own}))}
    idf = rng.random(len(index)) + 0.5
    send = spark.sparkContext.broadcast
    basis = latent_basis(spark, table, send(index), send(idf), 12)
    dense = np.zeros((12, len(index)))
    for n, own in enumerate(lists):
        for w in own:
            dense[n, index[w]] += idf[index[w]]
    assert np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-4
    assert np.abs(dense @ basis @ basis.T - dense).max() < 1e-3


def test_copies_of_many_items_of_all_lengths_are_found(spark):
    rng = random.Random(11)
    vocabulary = [f"term{n}" for n in range(3000)]
    drawn = [1 / (n + 5) for n in range(3000)]
    items = [" ".join(rng.choices(vocabulary, drawn, k=rng.randint(10, 60))) for _ in range(900)]
    filler = lambda n: " ".join(rng.choices(vocabulary, drawn, k=n))
    texts = [f"{filler(rng.randint(0, 200))} {x} {filler(rng.randint(0, 200))}" for x in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(spark, docs(spark, texts), bench).collect()}
    exact = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if f" {x} " in f" {t} "}
    assert len(exact) >= 900 and exact <= got


def test_no_common_words_of_enough_weight_give_a_smaller_product():
    rng = np.random.default_rng(5)
    for _ in range(300):
        counts, energy = rng.integers(1, 6, 8), rng.random(8) + 0.1
        least = least_product(counts, energy)
        there = rng.integers(0, 7, (50, 8))
        enough = np.minimum(counts, there) @ energy >= WEIGHT * (counts @ energy)
        assert ((counts * there * energy).sum(axis=1)[enough] >= least - 1e-9).all()
