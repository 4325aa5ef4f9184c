import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from helpers import given
from pyspark.sql import functions as F

from pulsegrid.llm.conversation_trie import LEAST, conversation_trie, sketch_bits

TURNS = "conv_id long, turn long, role string, text string, top long, d1 long, depth string, total long, part string"


def table(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 5, 6, "d", 7, "p") for r in rows], TURNS)


def own(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in held.items()}


def opened(rows):
    plain, out = own(rows), {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_nodes(conversations):
    """The nodes by walking over every prefix."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, subtree = defaultdict(list), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
        for d in range(len(node) + 1):
            subtree[node[:d]].append(node)
    out = []
    for node, own_ids in members.items():
        ends = ",".join(map(str, sorted(c for c in own_ids if len(conversations[c]) == len(node))))
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in subtree[node] if v)
        leaves = sum(not children[v] for v in subtree[node])
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_ids), len(node), parent, len(own_ids), len(children[node]), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_equal_to_a_walk_over_the_given_conversations(spark):
    rows = given("conversations", "conv_id, turn, role, text")
    made = conversation_trie(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), opened=True)
    assert rows_of(made) == plain_nodes(opened(rows))


def copies():
    """Copies of short and of long conversations, branches at every depth, ends inside."""
    rows = []
    for c in range(240):
        kind, size = c % 4, [3, 7, 1, 0][c % 4]
        for t in range(size):
            rows.append((c, t, "user" if t % 2 else None, f"kind {kind} turn {t}" if t < 5 or c % 3 else f"own {c} {t}"))
        if kind == 3:
            rows.append((c, None, None, None))
    for c in (301, 302, 303):
        rows += [(c, t, "user", f"long {t}" if t != 530 or c != 303 else "branch") for t in range(560)]
    return rows


@pytest.mark.parametrize(("build", "widest"), [(own, LEAST), (opened, 1 << 26)])
def test_copies_and_long_conversations(spark, build, widest):
    from pulsegrid.llm import conversation_trie as m

    rows = copies()
    turns = (m.opened_turns if build is opened else m.own_turns)(spark, table(spark, rows).repartition(7))
    assert rows_of(m.trie_nodes(spark, turns, widest)) == plain_nodes(build(rows))


def test_a_sketch_that_is_too_small_changes_nothing(spark, monkeypatch):
    from pulsegrid.llm import conversation_trie as m

    monkeypatch.setattr(m, "LEAST", 8)
    monkeypatch.setattr(m, "SENT", 3)
    rows = copies()
    turns = m.own_turns(spark, table(spark, rows))
    assert rows_of(m.trie_nodes(spark, turns, 8)) == plain_nodes(own(rows))


def test_edge_rows(spark):
    rows = [
        (1, 2, "user", "b"), (1, 1, "user", "a"), (1, None, "user", "first"), (1, None, None, "zero"),
        (2, 1, "user", "same"), (2, 1, "user", "same"), (2, 1, "assistant", "same"), (3, 1, "user", "same"),
        (None, 1, "user", "lost"), (-7, 0, "", ""), (-7, 1, None, None), (-8, 0, None, ""), (12_345_678_901, 0, "user", "x" * 100_000),
        (4, 0, "us", "erx"), (5, 0, "user", "x"), (6, 0, "user", "🙂é"), (7, 0, "user", "🙂é"),
    ]
    assert rows_of(conversation_trie(spark, table(spark, rows))) == plain_nodes(own(rows))
    lone = [(9, 0, "user", "only")]
    assert rows_of(conversation_trie(spark, table(spark, lone))) == plain_nodes(own(lone))
    assert conversation_trie(spark, table(spark, [])).count() == 0
    assert conversation_trie(spark, table(spark, []), opened=True).count() == 0


def test_an_estimate_of_one_is_never_wrong(spark):
    rows = spark.range(3000).select(F.xxhash64(F.floor(F.col("id") / 2)).alias("d1"), F.xxhash64(F.lit(3), F.floor(F.col("id") / 2)).alias("d2"))
    bits = sketch_bits(rows.repartition(5), 1 << 14)
    at = [np.array([r[c] for r in rows.collect()]).view(np.uint64) & np.uint64((1 << 14) - 1) for c in ("d1", "d2")]
    for row, own_at in zip(bits, at, strict=True):
        assert (np.unpackbits(row, bitorder="little")[own_at.astype(int)] == 1).all()
        assert np.unpackbits(row).mean() < 0.12
