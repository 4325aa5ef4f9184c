import random

from helpers import docs, given, long_text
from sentencepiece import SentencePieceProcessor

from pulsegrid.llm.piece_trie import PieceTrie, decode, encode
from pulsegrid.llm.vocabularies import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
CHARS = "aábc   's'relZ09½\n\t 　日本語🙂é<s>!?.,—ßΩ१‍\x1c▁theing  and"


def test_given_documents_match_the_library_and_decode(spark):
    library = SentencePieceProcessor(model_file=PATH)
    rows = given("documents", "doc_id, text")
    made = encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = {r["doc_id"]: r for r in made.collect()}
    for doc, text in rows:
        assert got[doc]["piece_ids"] == library.encode(text)
        assert got[doc]["n_pieces"] == len(got[doc]["piece_ids"]) and got[doc]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in decode(made, PATH).collect()}
    assert back == dict(rows)


def test_random_words_match_the_library():
    library, own, rng = SentencePieceProcessor(model_file=PATH), PieceTrie(PATH), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 40)))
        words = own.marked(text)
        own.learn(words)
        ids = own.encode(words).tolist()
        assert ids == library.encode(text)
        assert own.decode(ids) == text.replace("▁", " ")


def test_shared_prefixes_do_not_depend_on_the_order_of_words():
    one, two = PieceTrie(PATH), PieceTrie(PATH)
    words = ["▁the", "▁there", "▁thereof", "▁other", "▁", "x", "▁the日本"]
    assert one.encode_words(words) == {w: two.encode_words([w])[w] for w in words}


def test_edge_rows(spark):
    library = SentencePieceProcessor(model_file=PATH)
    long = long_text() + "x" * 3000
    table = docs(spark, [None, "", " ", long, "hi", "hi"], ids=[1, 2, 3, 4, None, None])
    got = sorted(((r["doc_id"], r["piece_ids"], r["round_trip"]) for r in encode(table, PATH).collect()), key=str)
    want = [(1, [], True), (2, [], True), (3, library.encode(" "), True), (4, library.encode(long), True)]
    want += [(None, library.encode("hi"), True)] * 2
    assert got == sorted(want, key=str)
    assert encode(docs(spark, []), PATH).count() == 0
    kept = encode(table, PATH, tuple(table.columns))
    assert kept.columns == [*table.columns, "piece_ids", "n_pieces", "round_trip"]
    assert kept.where("doc_id = 1").first()["text"] is None
    assert decode(encode(docs(spark, []), PATH), PATH).count() == 0


def test_words_of_former_generations_stay_right(monkeypatch):
    from pulsegrid.llm import piece_trie as m

    monkeypatch.setattr(m, "KEEP", 60)
    own = m.PieceTrie(PATH)
    library = SentencePieceProcessor(model_file=PATH)
    for n in range(12):
        texts = [f"the word{k * n} is number {k + n % 3} again" for k in range(9)]
        lists = [own.marked(t) for t in texts]
        own.learn(w for words in lists for w in words)
        assert [own.encode(words).tolist() for words in lists] == [library.encode(t) for t in texts]
        assert len(own.known) <= 60 and len(own.former) <= 60


def test_columns_with_clashing_names(spark):
    rows = [(1, "some text", "a", 7, 8, "b"), (None, None, "c", 9, 10, "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _ids string, n_pieces long, c0 long, round_trip string")
    made = encode(table, PATH, tuple(table.columns))
    assert made.columns == ["doc_id", "text", "_ids", "c0", "piece_ids", "n_pieces", "round_trip"]
    got = sorted(((r["doc_id"], r["text"], r["_ids"], r["c0"], r["n_pieces"] > 0, r["round_trip"]) for r in made.collect()), key=str)
    assert got == sorted([(1, "some text", "a", 8, True, True), (None, None, "c", 10, False, True)], key=str)
