"""Pseudonyms: formats, check digits, links, and what must stay."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shardfit.llm import pii

TEXTS = [
    "mail a.b42@x-y.example.com, card 4041894974608795 or 4041-8949-7460-8795 and 4041894974608796.",
    "+1 (988) 555-2485 then 988-555-2485 4524132264652876 53.121.55.90 and 300.1.1.1 v1.2.3",
    "born 1999-02-28, 28.02.1999, 02/28/1999, 31/12/2001; 1999-02-30 99.99.1999",
    "SSN 123-45-6789 666-12-1234; DE89370400440532013000 and DE89 3704 0044 0532 0130 00, DE88370400440532013000",
    None, "", "plain words only", "z@q.org " + "x" * 20000 + "@ " + "1" * 20000,
]


def luhn(number: str) -> bool:
    digits = [int(d) for d in number if d.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def run(spark, texts, secret="k"):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    return [tuple(r) for r in pii.pseudonymise(docs, secret).orderBy("doc_id").collect()]


def test_formats(spark):
    got = run(spark, TEXTS)
    assert [r[2] for r in got] == [5] * len(TEXTS)
    assert [r[3] for r in got] == [3, 4, 4, 3, 0, 0, 0, 1]
    cards = re.findall(r"\d[\d-]{15,}", got[0][1])
    assert cards[0] == cards[1].replace("-", "") != "4041894974608795" and luhn(cards[0]) and cards[0][0] == "4"
    assert cards[2] == "4041894974608796" and "@x-y.example.com" in got[0][1] and "a.b42@" not in got[0][1]
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", got[1][1])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "9885552485"
    assert got[1][1].startswith("+1 (") and "300.1.1.1 v1.2.3" in got[1][1] and "53.121.55.90" not in got[1][1]
    iso, dotted, us, _ = re.findall(r"\d+[-./]\d+[-./]\d+", got[2][1])[:4]
    y, m, d = iso.split("-")
    assert dotted == f"{d}.{m}.{y}" and us == f"{m}/{d}/{y}" and iso != "1999-02-28"
    assert got[2][1].endswith("1999-02-30 99.99.1999")
    one, two = re.findall(r"DE(?:\d{20}|\d\d(?: \d{4}){4} \d\d)", got[3][1])[:2]
    assert one == two.replace(" ", "") and iban(one) and "DE88370400440532013000" in got[3][1] and "666-12-1234" in got[3][1]
    assert got[4][1] is None and got[5][1] == "" and got[6][1] == TEXTS[6]
    assert len(got[7][1]) == len(TEXTS[7])


def test_international_numbers(spark):
    numbers = ["+33 6 12 34 56 78", "+33 1 23 45 67 89", "+33 (0)6 12 34 56 78", "+33612345678", "+49 30 1234567",
               "+44 20 7946 0958", "+420 2 2422 1111", "+1 2 3 4 5 6 7 8 9", "+123456789012345"]
    stay = ["+33 6 12", "+1234567890123456", "+0 12 34 56 78 90", "x+33 6 12 34 5y"]
    got = run(spark, [f"call {n}, now" for n in numbers] + [f"call {n}, now" for n in stay] + ["+49 30 1234567 3 apples"])
    for n, r in zip(numbers, got):
        new = r[1].removeprefix("call ").removesuffix(", now")
        assert r[3] == 1 and new != n and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", n), (n, r)
    assert all(new[1][5:8] == n[:3] for n, new in zip(numbers[:3], got))  # the country code stays
    assert [r[1] for r in got[len(numbers):-1]] == [f"call {n}, now" for n in stay]
    assert got[-1][1] == got[4][1].removeprefix("call ").removesuffix(", now") + " 3 apples"


def test_links_and_keys(spark):
    text = "4041894974608795 and bob@example.com, 10.20.30.40"
    a, b, c = (run(spark, [text, "see " + text], s) for s in ("k", "k", "other"))
    assert a == b and a[1][1] == "see " + a[0][1] and a[0][1] != c[0][1]


def test_permutations(spark):
    days = spark.range(73049).select(pii.permuted_number(F.col("id"), (17, 4297), "k", "date").alias("x"))
    assert tuple(days.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()) == (73049, 0, 73048)
    pins = spark.range(10000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "c").alias("x"))
    assert pins.distinct().count() == 10000


def test_empty_and_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = pii.pseudonymise(docs)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()


# the same again in plain Python ---------------------------------------------

def turned_text(text, kind, secret="k"):
    a, b = text[:len(text) // 2], text[len(text) // 2:]
    for turn in range(1, 9):
        digest = hashlib.sha256(f"{secret}|{kind}|{turn}|{b}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(a):
            for low, size in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(low) < size:
                    c = chr(ord(low) + (ord(c) - ord(low) + int(digest[2 * i:2 * i + 2], 16)) % size)
                    break
            out += c
        a, b = b, out
    return a + b


def turned_number(value, a, b, kind, secret="k"):
    x, y = divmod(value, b)
    for turn in range(1, 9):
        drawn = int(hashlib.sha256(f"{secret}|{kind}|{turn}|{y}".encode()).hexdigest()[:12], 16)
        x, y = y, (x + drawn) % (a if turn % 2 else b)
    return x * b + y


def new_date(date):
    low, days = (1, 9) if date.day <= 9 else (10, 3) if date.day <= 12 else (13, 19)
    first, months = (1, 9) if date.month <= 9 else (10, 3)
    v = ((date.year - 1900) * months + date.month - first) * days + date.day - low
    while True:
        v = turned_number(v, 50 * months, 4 * days, f"date{low}.{first}")
        rest, d = divmod(v, days)
        y, mo = divmod(rest, months)
        try:
            return datetime.date(1900 + y, first + mo, low + d)
        except ValueError:
            continue


CODES = {"1", "7", "20", "27", "33", "39", "44", "49", "86", "91", "98"}


def new_phone(text):
    body = text.replace("(0)", "(#)")
    digits = re.sub(r"\D", "", body)
    code = len(digits) - 10 if text[0] != "+" else next((n for n in (1, 2) if digits[:n] in CODES), 3)
    country, national = digits[:code], digits[code:]
    if country in ("", "1") and re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", national):
        v = ((int(national[:3]) - 200) * 100 + int(national[6:8])) * 80_000 + (int(national[3:6]) - 200) * 100 + int(national[8:])
        left, right = divmod(turned_number(v, 80_000, 80_000, "phone"), 80_000)
        new = f"{left // 100 + 200}{right // 100 + 200}{left % 100:02d}{right % 100:02d}"
    elif country in ("", "1"):
        rest = turned_text(national[1:3] + national[4:], "phone")
        new = national[0] + rest[:2] + national[3] + rest[2:]
    else:
        new = national[0] + turned_text(national[1:], "phone")
    each = iter(country + new)
    return re.sub(r"\d", lambda _: next(each), body).replace("(#)", "(0)")


def test_same_as_plain_python(spark):
    phones = ["+33 6 12 34 56 78", "+33612345678", "+33 (0)6 12 34 56 78", "+442079460958", "+44 20 7946 0958", "+1 (988) 555-2485",
              "988-555-2485", "+19885552485", "(123) 456-7890", "+1 024 555 1234", "+7 495 123-45-67", "+4930123456", "+353 1 234 5678"]
    dates = ["1999-02-28", "28.02.1999", "02/28/1999", "3.4.2020", "03.04.2020", "4/3/2020", "31/12/2001", "11.12.2099", "9.10.1900"]
    names = ["Bob.Smith42@example.com", "bob.smith42@example.com", "BOB.SMITH42@example.com", "x@y.org"]
    got = [r[1] for r in run(spark, phones + dates + names)]
    assert got[:len(phones)] == [new_phone(p) for p in phones]
    national = {re.sub(r"\D", "", got[i])[2:] for i in (0, 1)} | {re.sub(r"\D", "", got[2])[3:]}
    assert len(national) == 1 and got[0].startswith("+33 ") and got[2].startswith("+33 (0)")
    assert re.sub(r"\D", "", got[3]) == re.sub(r"\D", "", got[4]) and got[3].startswith("+44")
    assert re.sub(r"\D", "", got[5])[1:] == re.sub(r"\D", "", got[6]) == re.sub(r"\D", "", got[7])[1:]
    for text, new in zip(dates, got[len(phones):]):
        a, b, c = (int(x) for x in re.split(r"\D", text))
        mark = re.search(r"\D", text)[0]
        y, m, d = (a, b, c) if mark == "-" else (c, b, a) if mark == "." or a > 12 else (c, a, b)
        n = new_date(datetime.date(y, m, d))
        parts = [n.year, n.month, n.day] if mark == "-" else [n.day, n.month, n.year] if mark == "." or a > 12 else [n.month, n.day, n.year]
        widths = [len(x) for x in re.split(r"\D", text)]
        assert new == mark.join(str(x).zfill(w) for x, w in zip(parts, widths)), (text, new)
    for text, new in zip(names, got[len(phones) + len(dates):]):
        name, domain = text.split("@")
        twin = turned_text(name.lower(), "email")
        assert new == "".join(t.upper() if c.isupper() else t for c, t in zip(name, twin)) + "@" + domain
    assert len({n.lower() for n in got[len(phones) + len(dates):-1]}) == 1


@pytest.mark.parametrize("form", ["yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"])
def test_all_days_differ_in_every_form(spark, form):
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), form).alias("text"))
    new = pii.pseudonymise(days.repartition(8), "k").select(
        "text", F.length("text").alias("n"), F.regexp_replace("text", r"\d", "0").alias("shape"))
    old = days.select(F.length("text").alias("n"), F.regexp_replace("text", r"\d", "0").alias("shape"))
    assert new.select("text").distinct().count() == days.distinct().count()
    count = lambda df: {tuple(r) for r in df.groupBy("n", "shape").count().collect()}
    assert count(new) == count(old)


def test_day_and_month_are_read_as_before(spark):
    """What can only be day/month stays so, so that no two pseudonyms meet."""
    texts = [f"{a:02d}/{b:02d}/1987" for a in range(1, 32) for b in range(1, 32) if min(a, b) <= 12]
    got = [r[1] for r in run(spark, texts)]
    real = [(t, g) for t, g in zip(texts, got) if t != g]
    assert len({g for _, g in real}) == len(real) > 550
    assert all((int(t[:2]) > 12) == (int(g[:2]) > 12) for t, g in real)
