import numpy as np
import xxhash
from helpers import docs, given, long_text

from pulsegrid.llm.common import components
from pulsegrid.llm.simhash_planes import fingerprint_links, fingerprints, near_groups, one_of_each, sliced_links


def plain_fingerprint(text, width=3):
    data = (text or "").encode()
    words = [w for w in bytes(b + 32 if 65 <= b <= 90 else b for b in data).split()]
    if not words:
        return 0
    lines = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(line, seed=42) for line in lines]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, radius=3):
    """value -> smallest index reachable, by comparing all pairs."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def test_matches_brute_force_on_the_given_documents(spark):
    rows = given("documents", "doc_id, text")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_groups(spark, table).collect()}
    rows.sort()
    values = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(values)
    assert got == {d: (f"{v:016x}", rows[g][0]) for (d, _), v, g in zip(rows, values, groups, strict=True)}
    assert len({c for _, c in got.values()}) < len(rows)


def test_edge_rows(spark):
    long = long_text()
    texts = [None, "", " \n", "One two", "one TWO", long, long, "a b c d"]
    table = docs(spark, texts, ids=[5, 3, 9, 11, None, 20, 20, 8])
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_groups(spark, table).collect()), key=str)
    zero = "0" * 16
    two, four = (f"{plain_fingerprint(t):016x}" for t in ("one two", "a b c d"))
    large = f"{plain_fingerprint(long):016x}"
    want = [(5, zero, 3), (3, zero, 3), (9, zero, 3), (11, two, 11), (None, two, 11), (20, large, 20), (20, large, 20), (8, four, 8)]
    assert got == sorted(want, key=str)
    assert near_groups(spark, docs(spark, [])).count() == 0


def test_links_of_random_fingerprints_lose_no_pair(spark):
    random = np.random.default_rng(3)
    values = set()
    for _ in range(60):
        base = int(random.integers(0, 1 << 63)) * 2 + 1
        for _ in range(12):
            flips = random.choice(64, int(random.integers(0, 5)), replace=False)
            values.add(base ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius, chunk in ((3, 2048), (3, 5), (2, 2048), (0, 2048)):
        links = fingerprint_links(table, radius, chunk)
        got = {r["node"]: r["component"] for r in components(spark, links).collect()}
        groups = plain_groups(values, radius)
        want = {}
        for n, g in enumerate(groups):
            want.setdefault(g, []).append(signed[n])
        assert {frozenset(v) for v in want.values() if len(v) > 1} == {
            frozenset(k for k in got if got[k] == c) for c in set(got.values())
        }


def test_sliced_links_keep_asks_and_answers_apart():
    fps = np.array([0, 1, 3, 0xFF], np.uint64)
    left = np.array([True, True, False, False])
    labels = sliced_links(fps, np.array([0]), left, ~left, 3)
    assert labels.tolist() == [0, 0, 0, 3]


def test_counters_of_every_radius():
    random = np.random.default_rng(8)
    base = random.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = []
    for b in base:
        for n in range(70):
            flips = random.choice(64, n % 20, replace=False)
            fps.append(int(b) ^ sum(1 << int(f) for f in flips))
    fps = sorted(set(fps))
    every = np.ones(len(fps), bool)
    for radius in (0, 1, 2, 3, 5, 7, 8, 12, 15):
        labels = sliced_links(np.array(fps, np.uint64), np.array([0]), every, every, radius)
        assert labels.tolist() == plain_groups(fps, radius)


def test_one_of_each_keeps_clean_and_unjudged_rows(spark):
    long = " ".join(f"word{i}" for i in range(300))
    near = long.replace("word7 ", "other ").replace("word200 ", "")
    table = docs(spark, [long, near, "quite another text of its own", None, "", long, "a text"], ids=[4, 2, 6, 7, 8, None, 6])
    kept = sorted(((r["doc_id"], r["text"]) for r in one_of_each(spark, table).collect()), key=str)
    assert kept == sorted([(2, near), (6, "a text"), (7, None), (8, ""), (None, long)], key=str)
    assert one_of_each(spark, table).columns == table.columns
    assert one_of_each(spark, docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(spark, edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}
    assert components(spark, edges.limit(0)).count() == 0


def test_fingerprints_of_wide_shingles(spark):
    text = " ".join(f"x{i}" for i in range(50))
    assert fingerprints(docs(spark, [text]), 5).first()["fp"] % (1 << 64) == plain_fingerprint(text, 5)


def shingles(text, width=5):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_near_copies_are_those_of_the_shingles_similarity(spark):
    rng = np.random.default_rng(3)
    texts, alike = [], []
    for want in (0.5, 0.6, 0.7, 0.9):
        for _ in range(40):
            size = int(rng.integers(60, 400))
            common = round(2 * want * (size - 4) / (1 + want)) + 4
            a, b = ([f"w{n}" for n in rng.integers(0, 5000, size)] for _ in range(2))
            pair = [" ".join(a), " ".join(a[:common] + b[common:])]
            x, y = map(shingles, pair)
            texts += pair
            alike.append(len(x & y) / len(x | y) >= 0.8)
    kept = {r["doc_id"] for r in one_of_each(spark, docs(spark, texts)).collect()}
    assert alike.count(True) == 40
    assert kept == set(range(0, len(texts), 2)) | {2 * n + 1 for n, near in enumerate(alike) if not near}
