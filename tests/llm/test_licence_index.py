import random
import re

from helpers import docs, given, long_text

from pulsegrid.llm.licence_index import BASE, TEMPLATES, licence_scan, word_parts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files, to deal in the Software without restriction"
)


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def plain_base(text):
    words = plain_words(text)
    starts, labels = [], set()
    for phrase, label in BASE:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def scanned(table):
    return sorted(
        ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in licence_scan(table).collect()),
        key=str,
    )


def test_base_matches_brute_force_on_the_given_documents(spark):
    rows = given("documents", "doc_id, text")
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [g[:6] for g in got] == sorted(((d, *plain_base(t)) for d, t in rows), key=str)
    assert any(g[2] for g in got)
    for g in got:
        assert set(filter(None, g[5].split(","))) <= set(filter(None, g[6].split(","))) and 0 <= g[7] <= 1


def test_templates_and_edges(spark):
    long = long_text() + " MIT License " + long_text(50)
    texts = [
        None,
        "",
        "MIT License mit-license\tAPACHE... license",
        f"x y z {MIT}.",
        "This is a permission to any person, and a free copy",
        "Licensed under CC BY-NC 4.0.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        long,
        "general public licensé mit licenses",
        "general general public license",
        "general general public license",
    ]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 9]
    filler = [f"plain filler text number {n}" for n in range(30)]
    got = {(g[0], g[1]): g for g in scanned(docs(spark, texts + filler, ids + list(range(100, 130))))}
    for i, t in zip(ids, texts, strict=True):
        assert got[(i, len(plain_words(t)))][1:6] == plain_base(t)
    labels = {g[0]: g[6] for g in got.values()}
    assert labels[3] == "mit" and labels[5] == "cc-by-nc" and labels[6] == "bsd" and labels[2] == "apache,mit"
    assert labels[4] == labels[0] == labels[8] == labels[100] == "" and labels[None] == labels[9] == "gpl"
    assert licence_scan(docs(spark, [])).count() == 0


def test_word_parts_cut_between_words():
    text = "Ab,c " * 500_000
    words = [w for part in word_parts(text) for w in part]
    assert words == [b"ab", b"c"] * 500_000


def test_every_template_is_found_whole_and_with_changed_words(spark):
    rng = random.Random(2)
    texts, want = [], []
    for label, text, keys in TEMPLATES:
        words = text.split()
        texts.append("before it " + text.title() + ", after it")
        want.append(label)
        # Every sixth word outside the key phrases is another one.
        free = [i for i, w in enumerate(words) if not any(w in k.split() for k in keys)]
        for i in rng.sample(free, len(free) // 6):
            words[i] = "changed"
        texts.append("before it " + " ".join(words) + " after it")
        want.append(label)
    filler = [f"plain filler text number {n} of any kind" for n in range(400)]
    got = {g[0]: set(g[6].split(",")) for g in scanned(docs(spark, texts + filler))}
    missed = [(n, texts[n], got[n]) for n, label in enumerate(want) if label not in got[n]]
    assert not missed
    assert all(got[n] == {""} for n in range(len(texts), len(texts) + 400))
