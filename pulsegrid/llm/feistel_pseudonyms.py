"""Format-preserving Feistel pseudonyms for personal data, with DataFrame operations only.

Validated values are mapped to two numbers and permuted by an alternating Feistel network
with a keyed hash: each round adds to one number a hash of the other, modulo that number's
own range. So a card number stays a valid card number, a date a date, and an address an
address; equal values get equal pseudonyms in all documents, and the key gives them back.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: The session setting with the secret key of the query.
KEY_CONF = "spark.pulsegrid.pseudonym.key"
EPOCH = "1900-01-01"
#: Days from 1900 to 2099, as a product: the ranges of the two numbers of a date.
DAYS = (17, 4297)
#: Turns within which a date in its own kind of writing is met: over a fifth of all days fit.
WALK = 200

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])"
DATE = r"(?<![\w.-])(?:19|20)\d\d-\d{1,2}-\d{1,2}(?![\w-])"
SLASHED = r"(?<![\w.-]|\d/)(?:19|20)\d\d/\d{1,2}/\d{1,2}(?![\w-]|/\d)"
DAY_FIRST = r"(?<![\w.])\d{1,2}[./]\d{1,2}[./](?:19|20)\d\d(?![\w/])"
#: In one piece or in groups of four, of which the last has a digit.
COUNTRIES = "A[DELTZ]|B[AEGHIRY]|C[HRYZ]|D[EJKO]|E[EGS]|F[IKOR]|G[BEILRT]|HR|HU|I[ELQST]|JO|K[WZ]|L[BCITUVY]|M[CDEKNRTU]|N[ILO]|OM|P[KLST]|QA|R[OSU]|S[ACDEIKMOTV]|T[LNR]|UA|V[AG]|XK|YE"
IBAN = rf"(?<![A-Za-z0-9])(?:{COUNTRIES})\d\d(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: (?=[A-Z]{{0,3}}\d)[A-Z0-9]{{1,4}}))(?![A-Za-z0-9])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|-\d)"
PHONE = r"(?:(?<![\w+])\+?1[ .-])?(?<![\w(])\([2-9]\d\d\) ?[2-9]\d\d[ .-]\d{4}(?!\w)|(?<![\w.+-])(?:\+?1[ .-])?[2-9]\d\d[.-][2-9]\d\d[.-]\d{4}(?![\w-])"
ABROAD = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?)(?:[ .-]?\d{2,4}){2,4}(?!\w)"
ANY = "|".join((EMAIL, DATE, SLASHED, DAY_FIRST, IBAN, SSN, ADDRESS, CARD, PHONE, ABROAD))


def _long(value: Column) -> Column:
    return value.cast("long")


def keyed(key: str, *parts: Column | str) -> Column:
    """A number below 2^60 from the parts and a secret key: the head of a nested SHA-256, so
    that without the key no value can be worked out or confirmed."""
    fields = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *fields).cast("binary"), 256)
    outer = F.sha2(F.concat(F.lit(key), inner).cast("binary"), 256)
    return F.conv(F.substring(outer, 1, 15), 16, 10).cast("long")


def _permuted(a: Column, b: Column, m: Column, n: Column, kind: str, key: str, back: bool) -> Column:
    """struct(a, b): the pair after all rounds, a below m and b below n; ``back`` undoes it."""
    steps = list(range(ROUNDS, 0, -1)) if back else list(range(1, ROUNDS + 1))
    sign = -1 if back else 1

    def turned(acc: Column, step: Column) -> Column:
        own, other = acc["a"], acc["b"]
        on_a = F.pmod(own + sign * F.pmod(keyed(key, kind, step, other), m), m)
        on_b = F.pmod(other + sign * F.pmod(keyed(key, kind, step, own), n), n)
        odd = step % 2 == 1
        return F.struct(F.when(odd, on_a).otherwise(own).alias("a"), F.when(odd, other).otherwise(on_b).alias("b"))

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.struct(_long(a).alias("a"), _long(b).alias("b")), turned)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    places = F.split(shape, "")
    filled = F.transform(
        places,
        lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c),
    )
    return F.array_join(filled, "")


def _digit_feistel(digits: Column, kind: str, key: str, back: bool) -> Column:
    """A permutation of digit strings of one length (2 to 36 digits)."""
    size = F.length(digits)
    cut = F.floor(size / 2).cast("int")
    rest = (size - cut).cast("int")

    def power(n: Column) -> Column:
        return _long(F.rpad(F.lit("1"), n + 1, F.lit("0")))

    made = _permuted(F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, rest), power(cut), power(rest), kind, key, back)
    return _let(made, lambda p: F.concat(F.lpad(p["a"].cast("string"), cut, F.lit("0")), F.lpad(p["b"].cast("string"), rest, F.lit("0"))))


def luhn_sum(digits: Column, first_doubled: int) -> Column:
    """The Luhn sum of a digit string; from the right, digits at ``first_doubled`` (0 for the
    last one) and every second one before it count double."""
    def add(acc: Column, pair: Column) -> Column:
        twice = 2 * pair["d"]
        return acc + F.when(pair["i"] % 2 == first_doubled, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(pair["d"])

    pairs = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")),
    )
    return F.aggregate(pairs, F.lit(0), add)


def _card(value: Column, key: str, back: bool) -> Column:
    def made(digits: Column) -> Column:
        payload = _digit_feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key, back)
        return _let(payload, lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))

    return _let(_digits(value), lambda d: _let(made(d), lambda new: _refilled(value, new)))


def _address(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), _long)

    def made(o: Column) -> Column:
        return _permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "address", key, back)

    def shown(p: Column) -> Column:
        numbers = [F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256]
        return F.concat_ws(".", *[x.cast("string") for x in numbers])

    return _let(_let(octets, made), shown)


def _ssn(value: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (_long(F.substring(value, at, n)) for at, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    made = _permuted(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key, back)

    def shown(p: Column) -> Column:
        at = F.floor(p["a"] / 99)
        parts = ((F.when(at < 665, at + 1).otherwise(at + 2), 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return _let(made, shown)


def _read(value: Column, order: str) -> dict[str, Column]:
    """Year, month and day as they are written, by their order (such as "dmy")."""
    pieces = F.split(value, "[./-]")
    return {c: F.get(pieces, F.lit(n)) for n, c in enumerate(order)}


def _day(value: Column, order: str) -> Column:
    read = _read(value, order)
    padded = F.concat_ws("-", read["y"], F.lpad(read["m"], 2, "0"), F.lpad(read["d"], 2, "0"))
    return F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")).cast("date")


def _date(value: Column, order: str, key: str, back: bool) -> Column:
    """The date's permutation is repeated until its result can be written as the value is:
    one digit for one, and with the month first only what can't be read with the day first."""
    read, epoch = _read(value, order), F.lit(EPOCH).cast("date")

    def turned(days: Column) -> Column:
        made = _permuted(F.floor(days / DAYS[1]), days % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), "date", key, back)
        return _let(made, lambda p: _long(p["a"] * DAYS[1] + p["b"]))

    def fits(days: Column) -> Column:
        date = F.date_add(epoch, days.cast("int"))
        both = ((F.length(read["m"]) > 1) | (F.month(date) < 10)) & ((F.length(read["d"]) > 1) | (F.day(date) < 10))
        return both & (F.day(date) > 12) if order == "mdy" else both

    first = turned(_long(F.datediff(_day(value, order), epoch)))
    # A value in full digits, not month first, fits at once and needs no walk.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda acc, _: F.when(fits(acc), acc).otherwise(turned(acc)))
    short = (F.length(read["m"]) == 1) | (F.length(read["d"]) == 1) | F.lit(order == "mdy")
    days = F.when(short, walked).otherwise(first)

    def shown(n: Column) -> Column:
        date = F.date_add(epoch, n.cast("int"))
        new = {"y": F.year(date).cast("string")}
        for c, part in (("m", F.month(date)), ("d", F.day(date))):
            new[c] = F.when(F.length(read[c]) == 1, part.cast("string")).otherwise(F.lpad(part.cast("string"), 2, "0"))
        sign = F.regexp_extract(value, "[./-]", 0)
        return F.concat(new[order[0]], sign, new[order[1]], sign, new[order[2]])

    return _let(days, shown)


def _remainder(text: Column) -> Column:
    """The remainder by 97 of a text in which letters stand for 10 to 35."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban_valid(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "))
    check = F.substring(plain, 3, 2)
    right = (_remainder(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1) & check.between("02", "98")
    return F.when(value.rlike(f"^(?:{IBAN})$") & (F.length(_digits(plain)) >= 10), right).otherwise(False)


def _iban(value: Column, key: str, back: bool) -> Column:
    """The digits of the account are permuted and the check digits worked out anew; country
    and letters stay."""
    def made(plain: Column) -> Column:
        account = F.substring(plain, F.lit(5), F.length(plain))
        return _let(_digit_feistel(_digits(account), "iban", key, back), lambda new: F.concat(checked(plain, account, new), new))

    def checked(plain: Column, account: Column, new: Column) -> Column:
        left = _remainder(F.concat(_refilled(account, new), F.substring(plain, 1, 2), F.lit("00")))
        return F.lpad((98 - left).cast("string"), 2, "0")

    return _let(_let(F.replace(value, F.lit(" ")), made), lambda digits: _refilled(value, digits))


def _phone(value: Column, key: str, back: bool) -> Column:
    """Ten digits; area and exchange stay between 200 and 999. A country code 1 stays."""
    digits = _digits(value)
    own = F.substring(digits, -10, 10)

    def made(d: Column) -> Column:
        area, exchange, high, low = (_long(F.substring(d, at, n)) for at, n in ((1, 3), (4, 3), (7, 2), (9, 2)))
        return _permuted((area - 200) * 100 + high, (exchange - 200) * 100 + low, F.lit(80000), F.lit(80000), "phone", key, back)

    def shown(p: Column) -> Column:
        area, exchange = F.floor(p["a"] / 100) + 200, F.floor(p["b"] / 100) + 200
        ends = [F.lpad((p[c] % 100).cast("string"), 2, "0") for c in ("a", "b")]
        new = F.concat(F.regexp_replace(digits, r"\d{10}$", ""), area.cast("string"), exchange.cast("string"), *ends)
        return _let(new, lambda n: _refilled(value, n))

    return _let(_let(own, made), shown)


def _abroad(value: Column, key: str, back: bool) -> Column:
    """The first three digits (country and area) stay, the rest is permuted."""
    def made(d: Column) -> Column:
        new = F.concat(F.substring(d, 1, 3), _digit_feistel(F.substring(d, F.lit(4), F.length(d) - 3), "abroad", key, back))
        return _let(new, lambda n: _refilled(value, n))

    return _let(_digits(value), made)


def _email(value: Column, key: str, back: bool) -> Column:
    """Letters and digits of the local part, each within its kind; the domain stays. A single
    one is moved by a hash of the domain."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    steps = list(range(ROUNDS, 0, -1)) if back else list(range(1, ROUNDS + 1))
    sign = -1 if back else 1

    def moved(half: Column, other: Column, step: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            by = sign * F.pmod(keyed(key, "email", step, other, domain, i), F.lit(260))
            def within(low: str, n: int) -> Column:
                return F.char(F.pmod(F.ascii(c) - ord(low) + by, F.lit(n)) + ord(low))

            return (
                F.when(c.rlike("[0-9]"), within("0", 10)).when(c.rlike("[a-z]"), within("a", 26)).when(c.rlike("[A-Z]"), within("A", 26)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), char), "")

    def turned(acc: Column, step: Column) -> Column:
        odd = step % 2 == 1
        return F.struct(
            F.when(odd, moved(acc["a"], acc["b"], step)).otherwise(acc["a"]).alias("a"),
            F.when(odd, acc["b"]).otherwise(moved(acc["b"], acc["a"], step)).alias("b"),
        )

    cut = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), cut).alias("a"), F.substring(local, cut + 1, F.length(local)).alias("b"))
    made = F.aggregate(F.array(*[F.lit(s) for s in steps]), start, turned)
    return _let(made, lambda p: F.concat(p["a"], p["b"], F.lit("@"), domain))


def _kinds() -> list[tuple[str, object, object]]:
    """(kind, whether a found value is valid, its pseudonym), the first that holds counts."""
    whole = lambda pattern: lambda v: v.rlike(f"^(?:{pattern})$")
    span = lambda d: d.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date"))

    def dated(pattern: str, order: str):
        valid = lambda v: F.when(whole(pattern)(v), F.coalesce(span(_day(v, order)), F.lit(False))).otherwise(False)
        return valid, lambda v, k, b: _date(v, order, k, b)

    octets = lambda v: F.forall(F.split(v, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    return [
        ("email", lambda v: v.contains("@"), _email),
        ("date", *dated(r"\d{4}([/-])\d{1,2}\1\d{1,2}", "ymd")),
        ("date", *dated(r"\d{1,2}([./])\d{1,2}\1\d{4}", "dmy")),
        ("date", *dated(r"\d{1,2}([./])\d{1,2}\1\d{4}", "mdy")),
        ("iban", _iban_valid, _iban),
        ("ssn", whole(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"), _ssn),
        ("address", lambda v: F.when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), octets(v)).otherwise(False), _address),
        ("card", lambda v: F.when(v.rlike(r"^\d[\d -]*\d$") & F.length(_digits(v)).between(13, 19), luhn_sum(_digits(v), 1) % 10 == 0).otherwise(False), _card),
        ("phone", whole(r"(?:\+?1[ .-])?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]\d{4}"), _phone),
        ("phone", lambda v: v.startswith("+") & F.length(_digits(v)).between(8, 15), _abroad),
    ]


def _named(value: Column, key: str, back: bool) -> Column:
    """struct(kind, value): null and the value itself where it is not valid."""
    kind, new = F.lit(None).cast("string"), value
    for name, valid, made in reversed(_kinds()):
        fits = valid(value)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
        new = F.when(fits, made(value, key, back)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("value"))


def session_key(spark: SparkSession) -> str:
    """The key of ``KEY_CONF``; where it is not set, one that is drawn for this call and kept
    nowhere, so that its pseudonyms are linked among each other but never given back."""
    return spark.conf.get(KEY_CONF, None) or secrets.token_hex(32)


def pseudonymised(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_values, kinds (distinct, sorted, comma-joined).

    E-mail addresses, dates (1900 to 2099; day first where both can be meant), account numbers
    (IBAN), social security numbers, IPv4 addresses, card
    numbers with a right check digit, and telephone numbers are replaced; what looks like one
    but is not valid stays. With ``back`` and the same key the texts of a former result give
    the original values. Null texts stay null with 0 values; empty texts stay empty. Rows
    with a null or repeated doc_id are treated like others; an empty table gives no rows;
    other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hit = F.col("text").rlike("[0-9@]") & F.col("text").rlike(ANY)
    found = F.when(hit, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_new", F.transform("_found", lambda v: _named(v, key, back)))
    rows = rows.withColumn("_parts", F.when(F.size("_found") > 0, F.split("text", ANY)))
    joined = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_new"), i)["value"], F.lit("")))), "")
    valid = F.filter("_new", lambda v: v["kind"].isNotNull())
    return rows.select(
        "doc_id",
        F.when(F.size("_found") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.size(valid).cast("long").alias("n_values"),
        F.array_join(F.array_sort(F.array_distinct(valid["kind"])), ",").alias("kinds"),
    )
