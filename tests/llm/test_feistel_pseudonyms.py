import datetime
import re

from helpers import docs, given, long_text

from pulsegrid.llm.feistel_pseudonyms import pseudonymised

CARD = re.compile(r"\b\d{16}\b")


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def test_given_documents_lose_their_values_and_get_them_back(spark):
    rows = given("documents", "doc_id, text")
    made = pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "a key").cache()
    got = {r["doc_id"]: r for r in made.collect()}
    pairs = {}
    for d, t in rows:
        old, new = CARD.findall(t), CARD.findall(got[d]["text"])
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            if luhn(a):
                assert a != b and luhn(b) and pairs.setdefault(a, b) == b
        # Only addresses change their length, by their digits.
        assert re.sub(r"[0-9]", "", t).count(" ") == re.sub(r"[0-9]", "", got[d]["text"]).count(" ")
        if not re.search(r"[0-9@]", t):
            assert got[d]["text"] == t and got[d]["n_values"] == 0
    assert pairs
    back = {r["doc_id"]: r["text"] for r in pseudonymised(made, "a key", back=True).collect()}
    assert back == dict(rows)


def test_kinds_formats_and_links(spark):
    texts = [
        "call +1 (234) 567-8901 or 234-567-8901, 4111111111111111 99",
        "card 4111 1111 1111 1111; 10.20.30.40.",
        "mail Ann.Bee2@mail.example.com, born 1987-02-28, 28.02.1987, 28/02/1987",
        "ssn 123-45-6789",
        "not 000-12-3456 4111111111111112 999.1.1.1 1999-02-30 01.2.3 12345",
        "+44 20 7946 0958",
    ]
    got = [(r["text"], r["kinds"], r["n_values"]) for r in pseudonymised(docs(spark, texts), "a key").orderBy("doc_id").collect()]
    assert got[4] == (texts[4], "", 0)
    assert [g[1:] for g in got] == [("card,phone", 3), ("address,card", 2), ("date,email", 4), ("ssn", 1), ("", 0), ("phone", 1)]
    one, two = re.search(r"\+1 (.*?) or (\S+),", got[0][0]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "2345678901"
    card = re.search(r"\d{16}", got[0][0])[0]
    assert card == re.search(r"(\d{4} ){3}\d{4}", got[1][0])[0].replace(" ", "") and luhn(card)
    day, dotted, slashed = re.search(r"born (\S+), (\S+), (\S+)", got[2][0]).groups()
    day = datetime.date.fromisoformat(day)
    assert dotted == day.strftime("%d.%m.%Y") and slashed == day.strftime("%d/%m/%Y")
    assert re.search(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail\.example\.com", got[2][0])
    assert all(0 <= int(o) <= 255 for o in re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", got[1][0]).groups())
    other = pseudonymised(docs(spark, texts[3:4]), "another key").first()["text"]
    assert other not in (got[3][0], texts[3])


def test_a_permutation_has_no_collisions(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(n) for n in range(3000)]
    made = pseudonymised(docs(spark, [d.isoformat() for d in days]), "a key").collect()
    assert len({r["text"] for r in made}) == 3000


def test_edge_rows(spark):
    long = long_text() + " a@b.example " + "x" * 100_000 + "@"
    texts = [None, "", "@", "1" * 5000, long, "a@b.example", "a@b.example"]
    got = sorted(((r["doc_id"], r["n_values"]) for r in pseudonymised(docs(spark, texts, [1, 2, 3, 4, 5, None, None]), "a key").collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (None, 1), (None, 1)], key=str)
    assert pseudonymised(docs(spark, []), "a key").count() == 0


def test_month_first_one_digit_dates_and_account_numbers(spark):
    texts = [
        "12/31/1987", "02/28/1987", "02.28.1987", "1987/02/28", "2/28/1987", "1/2/1987", "3.4.1987", "1987-2-8", "1987/12/8", "01/02/1987",
        "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32",
    ]
    wrong = ["13/13/1987", "2/30/1987", "1987/13/01", "DE88370400440532013000"]
    made = pseudonymised(docs(spark, [f"on {t} AND" for t in texts + wrong]), "a key").cache()
    got = [(r["text"][3:-4], r["n_values"], r["kinds"]) for r in made.orderBy("doc_id").collect()]
    assert got[len(texts):] == [(t, 0, "") for t in wrong]
    for old, (new, n, kind) in zip(texts, got, strict=False):
        assert new != old and n == 1 and kind == ("iban" if old[0] in "DG" else "date")
        assert re.sub(r"\d", "0", old) == re.sub(r"\d", "0", new)
        if kind == "iban":
            plain = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[10][0] == got[11][0].replace(" ", "")
    for new, _, _ in got[:3]:
        month, day, _ = map(int, re.split("[./]", new))
        assert month <= 12 < day
    back = pseudonymised(made, "a key", back=True).orderBy("doc_id").collect()
    assert [r["text"][3:-4] for r in back] == texts + wrong


def test_the_key_comes_from_the_session_or_is_drawn(spark):
    from pulsegrid.llm.feistel_pseudonyms import KEY_CONF, session_key

    assert len({session_key(spark) for _ in range(3)}) == 3
    spark.conf.set(KEY_CONF, "own")
    try:
        assert session_key(spark) == "own"
    finally:
        spark.conf.unset(KEY_CONF)
