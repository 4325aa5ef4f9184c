import zlib

import numpy as np
from helpers import docs, given, long_text

from pulsegrid.llm.language_masks import Filters, fit_filters, grams, identify, known_language, rows_of


def is_held_out(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def test_held_out_accuracy_on_the_given_documents(spark):
    rows = given("documents", "doc_id, text, lang")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(spark, table).collect()}
    lang = {d: g for d, _, g in rows}
    assert all(got[d]["held_out"] == is_held_out(d) for d in lang)
    held = [d for d in lang if is_held_out(d)]
    right = [got[d]["lang_pred"] == lang[d] for d in held]
    assert len(held) > 20 and np.mean(right) > 0.95


def test_held_out_labels_are_not_learned(spark):
    ids = [n for n in range(40) if is_held_out(n)][:3] + [n for n in range(40) if not is_held_out(n)][:3]
    langs = ["xx"] * 3 + ["en"] * 3
    got = identify(spark, docs(spark, ["some words here"] * 6, ids, langs)).collect()
    assert {r["lang_pred"] for r in got} == {"en"}


def test_masks_hold_every_gram_of_their_language():
    langs = [f"l{n:02d}" for n in range(70)]
    table = np.zeros((1 << 20, 2), np.uint64)
    texts = {g: f"word{g} only{g}" for g in langs}
    for n, g in enumerate(langs):
        for values in grams(texts[g]):
            for rows in rows_of(values):
                table[rows, n // 63] |= np.uint64(1 << (n % 63))
    # Seventy languages take two words of masks; ASCII digits are no letters, so use letters.
    own = Filters(["aa", "bb"], np.zeros((1 << 20, 1), np.uint64), np.zeros(2))
    for n, text in enumerate(("lorem ipsum dolor", "completely different")):
        for values in grams(text):
            for rows in rows_of(values):
                own.table[rows, 0] |= np.uint64(1 << n)
    assert own.predict("ipsum lorem")[0] == "aa" and own.predict("different")[0] == "bb"
    assert Filters(langs, table, np.zeros(70)).predict("word")[0] == "l00"


def test_edge_rows(spark):
    langs = ["en", None, "en", "de", "de", None, "en", "en"]
    texts = ["the cat", None, "", "die katze", "123 !?", "katze", long_text(), "the cat"]
    ids = [n for n in range(60) if not is_held_out(n)][:6] + [None, None]
    got = {(r["doc_id"], r["lang_pred"]) for r in identify(spark, docs(spark, texts, ids, langs)).collect()}
    assert got >= {(ids[0], "en"), (ids[1], "und"), (ids[2], "und"), (ids[3], "de"), (ids[4], "und"), (ids[5], "de")}
    assert identify(spark, docs(spark, [])).count() == 0
    bare = identify(spark, docs(spark, ["text"], [1], [None])).collect()
    assert [(r["lang_pred"], r["score"]) for r in bare] == [("und", 0.0)]


def test_stage_keeps_known_languages_only(spark):
    good = ["the quick brown fox jumps over the lazy dog"] * 8
    learned, unseen = ([n for n in range(80) if is_held_out(n) == held] for held in (False, True))
    table = docs(spark, [*good, "zzzqx wvvkj xqqz", "1234", None], learned[:8] + unseen[:3])
    kept = known_language(spark, table, 0.5)
    assert kept.columns == table.columns and kept.count() == 8


def test_many_languages_fit(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(n, (letters[n % 26] * 2 + letters[n // 26] * 3 + " ") * 5, f"l{n:02d}") for n in range(70)]
    fitted = fit_filters(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.table.shape[1] == 2
    assert sum(fitted.predict(t)[0] == g for _, t, g in rows) == 70


def test_single_letters_get_a_language(spark):
    texts = ["the house and the garden"] * 3 + ["das haus und der garten"] * 3 + ["a", "I", "5 a 3", "A.", "5 3", ""]
    langs = ["en"] * 3 + ["de"] * 3 + [None] * 6
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark, docs(spark, texts, langs=langs)).collect()}
    assert all(got[n] in ("de", "en") for n in range(6, 10)) and got[10] == got[11] == "und"
