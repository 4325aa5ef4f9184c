import random

import pytest
from helpers import docs, given, long_text
from tokenizers import Tokenizer

from pulsegrid.llm.prefix_counts import PrefixCounter, PrefixTable, token_counts, truncated
from pulsegrid.llm.vocabularies import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
CHARS = "aábc 's'relZ09½  \n\t 　日本語🙂é!?.,—ßΩ१‍\x1c\x85"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def test_counts_of_the_given_documents(spark, library):
    rows = given("documents", "doc_id, text")
    got = {r["doc_id"]: r for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for doc, text in rows:
        n = library(text)
        assert (got[doc]["n_tokens"], got[doc]["n_bytes"], got[doc]["over_limit"]) == (n, len(text.encode()), n > 1024)


def test_random_texts_and_all_their_prefixes(library):
    counter, rng = PrefixCounter(PATH), random.Random(5)
    for n in range(1200):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>x", " <|endoftext|>"])
        assert counter.count(text) == library(text)
        if n < 200 and "<|" not in text:
            table = PrefixTable(counter, text)
            assert [table.at(k) for k in range(len(text) + 1)] == [library(text[:k]) for k in range(len(text) + 1)]


def test_edge_rows(spark, library):
    long = long_text() + "x" * 3000
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts(docs(spark, [None, "", long, "hi", "hi"], ids=[1, 2, 3, None, None]), PATH).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, library(long)), (None, 1), (None, 1)], key=str)
    assert token_counts(docs(spark, []), PATH).count() == 0


def test_truncation_is_the_longest_that_fits(spark, library):
    text = given("documents", "text", "LIMIT 1")[0][0]
    for limit in (0, 1, 7, 50):
        cut = truncated(docs(spark, [text, None]), PATH, limit).orderBy("doc_id").collect()
        assert cut[1]["text"] is None and text.startswith(cut[0]["text"])
        assert library(cut[0]["text"]) <= limit
        assert limit == 0 or library(cut[0]["text"]) == limit
