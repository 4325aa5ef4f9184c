import re

from helpers import docs, given, long_text
from pyspark.sql import functions as F

from pulsegrid.llm.fuzzy_lines import NEAR, SIGNS, buckets, cleaned, simhashes, without_repeats, word_bound


def plain_norm(line):
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line.lower()).strip(" ")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_simhash_is_the_majority_of_bits(spark):
    lines = [" ".join(f"w{k}" for k in [*range(n), 0, 1]) for n in (1, 2, 3, 50, 254, 255, 256, 510, 3000)] + ["a b b", "a b b"]
    rows = spark.createDataFrame([(1, n, line) for n, line in enumerate(lines)], "doc_id long, pos int, norm string").withColumn("node", F.xxhash64("norm"))
    hashes = rows.select("node", F.transform(F.array_distinct(F.split("norm", " ")), lambda w: F.xxhash64(w)).alias("h"))
    want = {r["node"]: sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in r["h"]) > len(r["h"])) for r in hashes.collect()}
    got = simhashes(rows.drop("node")).collect()
    assert {r["node"]: r["sig"] for r in got} == want
    assert sorted(r["pos"] for r in got) == list(range(11))


def test_words_bound_the_edit_distance(spark):
    words = [f"word{n}" for n in range(60)]
    line = " ".join(words)
    pairs = [
        # Words that go at one place and come at another shift all between them.
        (line, " ".join([*words[1:50], "more", "of", "them", *words[50:]])),
        (line, " ".join(["first", *words[:30], "ward30", *words[32:]])),
        (line, " ".join(reversed(words))),
        ("", "a"), ("a", "a b"), ("a a a", "b"), ("x  y", "x y"), ("\u4e00 b", "b \u4e00\u4e00"),
    ]
    many = " ".join(f"w{n}" for n in range(len(SIGNS) + 1))
    long = [f"word{n}" for n in range(200)]
    far = (" ".join(long), " ".join(reversed(long)))
    table = spark.createDataFrame([*pairs, (many, "w1"), far], "l string, r string")
    got = {(x["l"], x["r"]): x["n"] for x in table.select("l", "r", word_bound(F.col("l"), F.col("r")).alias("n")).collect()}
    assert got.pop((many, "w1")) is None and got.pop(far) is None
    assert all(edit_distance(*pair) <= n for pair, n in got.items())
    assert all(got[pair] <= 0.2 * len(line) for pair in pairs[:2])


def test_exact_repeats_of_the_given_documents(spark):
    rows = given("documents", "doc_id, text")
    made = {r["row"]["doc_id"]: r for r in cleaned(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, similar = {}, 0
    for d, t in sorted(rows):
        for n, line in enumerate(t.split("\n")):
            norm = plain_norm(line)
            if len(norm) < 20:
                assert n not in made[d]["removed"]
            elif norm in seen:
                assert n in made[d]["removed"]
            else:
                seen[norm] = (d, n)
                similar += n in made[d]["removed"]
        lines = t.split("\n")
        assert made[d]["text"] == "\n".join(x for n, x in enumerate(lines) if n not in set(made[d]["removed"]))
        assert made[d]["n_lines"] == len(lines)
    assert similar > 0


def test_near_lines_link_and_different_ones_do_not(spark):
    # One word in 250 moves three bits of the SimHash at most, which the blocks never miss.
    line = " ".join(f"word{n}" for n in range(250))
    near = line.replace("word7 ", "ward7 ")
    turned = " ".join(reversed(line.split()))
    other = " ".join(f"thing{n}" for n in range(40))
    table = docs(spark, [f"{line}\n{other}", f"head\n{near}", turned, other.upper() + "!"], ids=[1, 2, 3, 4])
    got = {r["row"]["doc_id"]: r["removed"] for r in cleaned(spark, table).collect()}
    assert edit_distance(line, near) <= 0.2 * len(line) < edit_distance(line, turned)
    assert got == {1: [], 2: [1], 3: [], 4: [0]}


def test_lines_of_one_simhash_are_all_compared(spark):
    # The same distinct words give one SimHash; two orders of them are two groups of similar lines.
    words = [f"token{n}" for n in range(40)]
    there, back = " ".join(words), " ".join(reversed(words))
    texts = [there, back, f"{there} token39", f"{back} token0", f"{there} token39 token39", f"{back} token0 token0"]
    nodes = simhashes(docs(spark, texts).selectExpr("doc_id", "0 AS pos", "text AS norm")).select("sig").distinct()
    assert nodes.count() == 1
    got = {r["row"]["doc_id"]: r["removed"] for r in cleaned(spark, docs(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: [0], 3: [0], 4: [0], 5: [0]}


def test_the_last_node_of_a_simhash_is_compared(spark):
    # Three nodes of one SimHash; the two similar ones both differ from the first.
    words = [f"token{n}" for n in range(40)]
    there, back = " ".join(words), " ".join(reversed(words))
    rows = spark.createDataFrame([(f"{t} token{n}",) for t in (there, back) for n in range(10)], "x string")
    found = {r["x"]: r["h"] for r in rows.selectExpr("x", "xxhash64(x) AS h").collect()}
    for one, two in ((there, back), (back, there)):
        behind = [x for x in found if x.startswith(two)]
        first = min((x for x in found if x.startswith(one)), key=found.get)
        behind = [x for x in behind if found[x] > found[first]]
        if len(behind) >= 2:
            break
    texts = [first, *behind[:2]]
    got = {r["row"]["doc_id"]: r["removed"] for r in cleaned(spark, docs(spark, texts)).collect()}
    assert got == {0: [], 1: [], 2: [0]}


def test_nodes_without_a_near_one_leave_their_bucket(spark):
    # Bits 0 to 25 are equal, so all meet in one bucket; of the rest a few nodes have near ones.
    def table(n):
        sigs = [k * 0x9E3779B97F4A7C15 % (1 << 37) << 26 for k in range(1, n + 1)]
        sigs += [sigs[0] ^ 1 << 62, sigs[1] ^ 7 << 40]
        return spark.createDataFrame(list(enumerate(sigs)), "node long, sig long")

    for n in (3, 5, 40):
        rows = {r["node"]: r["sig"] for r in table(n).collect()}
        near = {a for a, x in rows.items() for b, y in rows.items() if a != b and (x ^ y).bit_count() <= NEAR}
        kept = {r["head"] for r in buckets(table(n)).where("g = 0").collect()}
        assert kept == near if n < 8 else kept == set(rows)


def test_a_large_group_of_variants_keeps_one(spark):
    base = [f"token{n}" for n in range(60)]
    texts = []
    for n in range(300):
        own = list(base)
        own[n % 60] = f"new{n}"
        texts.append(" ".join(own))
    got = cleaned(spark, docs(spark, texts)).where("size(removed) = 0").collect()
    assert min(r["row"]["doc_id"] for r in got) == 0 and len(got) < 40


def test_edge_rows(spark):
    long = long_text()
    line = "a line that is long enough to count"
    texts = [None, "", line, f"{line}\nshort\nshort", line, line, long, f"{long}\n\n", "\n".join([line] * 3)]
    table = docs(spark, texts, ids=[1, 2, 3, 4, None, 3, 6, 7, 8])
    got = sorted(((r["row"]["doc_id"], r["n_lines"], r["removed"], r["text"]) for r in cleaned(spark, table).collect()), key=str)
    want = [
        (1, 0, [], None), (2, 1, [], ""), (3, 1, [], line), (3, 1, [], line), (4, 3, [0], "short\nshort"), (None, 1, [], line),
        (6, 1, [], long), (7, 3, [0], "\n"), (8, 3, [0, 1, 2], ""),
    ]
    assert got == sorted(want, key=str)
    kept = without_repeats(spark, table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 3, 4, 6, None]
    assert cleaned(spark, docs(spark, [])).count() == 0
