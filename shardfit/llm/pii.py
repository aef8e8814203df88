"""Format-preserving pseudonyms for personal data, in column expressions alone.

A match of a personal-data pattern is validated (check digits, calendar, octets) and replaced
by another valid value of the same format: a keyed Feistel network permutes the values of the
format. Under one key equal values get equal pseudonyms in every document and different values
different ones, so records stay linked; without the key they cannot be told. Separators stay.

| kind | valid if | permuted |
|---|---|---|
| e-mail | name of 1 to 64 characters, dotted domain | letters and digits of the name, whatever their case, each in its class |
| IBAN | remainder 1 modulo 97 | account part; check digits are computed anew |
| IPv4 | four octets up to 255 | all 2^32 addresses |
| card | 13 to 19 digits, Luhn sum | all but the first; check digit is computed anew |
| SSN | no reserved area, group or serial | valid areas, groups and serials |
| date | a day of 1900 to 2099; ISO, d.m.y, m/d/y, else d/m/y | the days that every form writes alike: see `_date` |
| phone | ten digits, or + and 8 to 15 | American numbers among themselves; others but country code and next digit |

A date, a phone number or an e-mail name has one pseudonym in all its spellings.

Nothing is shuffled; the secret should come from a secret store, not from the source.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardfit.llm.common import fresh

ROUNDS = 8  # even, so that both halves come back to their places
AMERICAN = (800 * 100, 800 * 100)  # area codes and exchanges 200..999, four more digits
WALK = 64  # most steps to the next day of the calendar; a step fails for one value in thirty
#: Country calling codes of one and two digits; all others have three.
SHORT_CODES = r"(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SSN = (898 * 99, 9999)          # areas 1..899 without 666 and groups 1..99; serials 1..9999

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MORE = r"(?:[ .-]?\(?\d\)?){7,14}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<![\w.])(?:\d{13,19}+|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{1,2}(?<dot>[./])\d{1,2}\k<dot>(?:19|20)\d{2})(?![\w-]|[./]\d)",
    "phone": r"(?<![\w.])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
             # digit by digit; a single digit after a space ends a number only if nothing before it can
             rf"|\+[1-9]{_MORE}(?<=\d\d\)?)(?!\w)|\+[1-9]{_MORE})(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = "[0-9@]"  # every match has one; most texts have none and are told at once


def _digest(secret: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), turn.cast("string"), value), 256)


def _shifted(text: Column, digest: Column) -> Column:
    """Every digit and letter moved within its class by two hexadecimal digits of the digest."""

    def moved(i: Column) -> Column:
        code = F.ascii(F.substr(text, i, F.lit(1)))
        by = F.conv(F.substr(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
        ring = lambda low, size: F.char(F.lit(low) + (code - low + by) % size)
        return (F.when(code.between(48, 57), ring(48, 10)).when(code.between(97, 122), ring(97, 26))
                .when(code.between(65, 90), ring(65, 26)).otherwise(F.substr(text, i, F.lit(1))))

    places = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(places, moved), ""))


def permuted_text(text: Column, secret: str, kind: str) -> Column:
    """Feistel network over a string of up to 64 characters; classes of characters stay."""
    half = F.floor(F.length(text) / 2).cast("int")
    first = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))
    last = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), first,
        lambda s, turn: F.struct(s["b"].alias("a"), _shifted(s["a"], _digest(secret, kind, turn, s["b"])).alias("b")),
        lambda s: F.concat(s["a"], s["b"]))
    return last


def permuted_number(value: Column, sizes: tuple, secret: str, kind: str) -> Column:
    """Feistel network over 0 .. a*b-1 by the two digits of the value to the bases a and b, numbers or columns."""
    a, b = (size if isinstance(size, Column) else F.lit(size) for size in sizes)
    value = value.cast("bigint")
    first = F.struct(F.floor(value / b).cast("bigint").alias("x"), (value % b).alias("y"))

    def turn_of(s: Column, turn: Column) -> Column:
        size = F.when(turn % 2 == 1, a).otherwise(b).cast("bigint")
        drawn = F.conv(F.substring(_digest(secret, kind, turn, s["y"].cast("string")), 1, 12), 16, 10).cast("bigint")
        return F.struct(s["y"].alias("x"), ((s["x"] + drawn) % size).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, turn_of,
                       lambda s: s["x"] * b.cast("bigint") + s["y"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, one after the other."""

    def place(i: Column) -> Column:
        char = F.substr(text, i, F.lit(1))
        rank = F.length(_digits(F.substr(text, F.lit(1), i)))
        return F.when(char.rlike(r"\d"), F.substr(digits, rank, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), place), "")


def luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the digits with every other one doubled, counted from the right."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when(i % 2 == (1 if last_doubled else 0), doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def mod_97(text: Column) -> Column:
    """Remainder of a number in which letters stand for 10 to 35."""

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(text, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _bound(value: Column, make) -> Column:
    """`make` of a value that is computed once."""
    return F.transform(F.array(value), make)[0]


def _email(m: Column, secret: str) -> Column:
    """The name is permuted in small letters and gets its capitals back, so case tells no names apart."""
    name = F.substring_index(m, "@", 1)

    def cased(new: Column) -> Column:
        def one(i: Column) -> Column:
            char = F.substr(new, i, F.lit(1))
            return F.when(F.substr(name, i, F.lit(1)).rlike("[A-Z]"), F.upper(char)).otherwise(char)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(name)), one), "")

    new = _bound(permuted_text(F.lower(name), secret, "email"), cased)
    return F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, secret: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain))
    valid = mod_97(F.concat(account, F.substring(plain, 1, 4))) == 1
    new = permuted_text(account, secret, "iban")
    check = F.lpad((98 - mod_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    spaced = F.transform(
        F.sequence(F.lit(1), F.length(m)),
        lambda i: F.when(F.substr(m, i, F.lit(1)) == " ", " ").otherwise(
            F.substr(F.concat(country, check, new), F.length(F.regexp_replace(F.substr(m, F.lit(1), i), " ", "")), F.lit(1))))
    return F.when(valid, F.array_join(spaced, ""))


def _ip(m: Column, secret: str) -> Column:
    number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda t, x: t * 256 + x.cast("bigint"))
    octets = F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]),
                         lambda s: F.pmod(F.floor(number_new(number, secret) / F.pow(F.lit(2.0), s)), F.lit(256)).cast("int").cast("string"))
    return F.array_join(octets, ".")


def number_new(number: Column, secret: str) -> Column:
    return permuted_number(number, (1 << 16, 1 << 16), secret, "ip")


def _card(m: Column, secret: str) -> Column:
    digits = _digits(m)
    body = F.concat(F.substring(digits, 1, 1),
                    permuted_text(F.substr(digits, F.lit(2), F.length(digits) - 2), secret, "card"))
    check = F.pmod(10 - luhn_sum(body, True), F.lit(10)).cast("string")
    return F.when(luhn_sum(digits, False) == 0, refilled(m, F.concat(body, check)))


def _ssn(m: Column, secret: str) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("bigint") for p, n in ((1, 3), (5, 2), (8, 4)))
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permuted_number((area * 99 + group - 1) * SSN[1] + serial - 1, SSN, secret, "ssn")
    parts = F.transform(F.array(new), lambda n: F.struct(
        F.floor(n / (SSN[1] * 99)).alias("area"), (F.floor(n / SSN[1]) % 99 + 1).alias("group"), (n % SSN[1] + 1).alias("serial")))[0]
    area = F.when(parts["area"] + 1 >= 666, parts["area"] + 2).otherwise(parts["area"] + 1)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(area, 3), pad(parts["group"], 2), pad(parts["serial"], 4))


def _read_date(m: Column) -> Column:
    """Form, texts of month and day, year, month and day of a date; null if it is none."""
    forms = (r"^(\d+)(-)(\d+)-(\d+)$", (1, 3, 4)), (r"^(\d+)([.])(\d+)\.(\d+)$", (4, 3, 1)), \
        (r"^(\d+)(/)(\d+)/(\d+)$", (4, 1, 3)), (r"^(\d+)(/)(\d+)/(\d+)$", (4, 3, 1))
    found = []
    for form, (shape, order) in enumerate(forms):
        texts = [F.regexp_extract(m, shape, g) for g in order]
        y, mo, d = (t.try_cast("int") for t in texts)
        month = F.make_date(y, F.when(mo.between(1, 12), mo), F.lit(1))
        fits = m.rlike(shape) & mo.between(1, 12) & (d >= 1) & (d <= F.dayofmonth(F.last_day(month)))
        found.append(F.when(fits, F.struct(
            F.lit(form).alias("form"), F.length(texts[1]).alias("wide_month"), F.length(texts[2]).alias("wide_day"),
            y.alias("y"), mo.alias("mo"), d.alias("d"))))
    return F.coalesce(*found)


def _date(m: Column, secret: str) -> Column:
    """ISO, day.month.year, month/day/year, or day/month/year where no month/day/year is meant.

    Days are permuted among those of the same kind: up to 9, up to 12 or later in the month, in a
    month up to 9 or later. So a date keeps its width where numbers have no leading zero, and one
    that can only be day/month stays so; all forms of a date give forms of the same date.
    """
    def changed(p: Column) -> Column:
        low = F.when(p["d"] <= 9, 1).when(p["d"] <= 12, 10).otherwise(13)
        days = F.when(p["d"] <= 9, 9).when(p["d"] <= 12, 3).otherwise(19)
        first, months = F.when(p["mo"] <= 9, 1).otherwise(10), F.when(p["mo"] <= 9, 9).otherwise(3)

        def year(v):
            return F.lit(1900) + F.floor(v / (days * months)).cast("int")

        def month(v):
            return first + (F.floor(v / days) % months).cast("int")

        def day(v):
            return low + (v % days).cast("int")

        def turned(v):  # a kind has 200 years of months and days
            kind = F.concat(F.lit("date"), low.cast("string"), F.lit("."), first.cast("string"))
            return permuted_number(v, (50 * months, 4 * days), secret, kind)

        def exists(v):
            return day(v) <= F.dayofmonth(F.last_day(F.make_date(year(v), month(v), F.lit(1))))

        value = ((p["y"] - 1900) * months + p["mo"] - first) * days + p["d"] - low
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), turned(value),
                             lambda v, _: F.when(exists(v), v).otherwise(turned(v)))

        def printed(v):
            mo, d = F.lpad(month(v).cast("string"), p["wide_month"], "0"), F.lpad(day(v).cast("string"), p["wide_day"], "0")
            y = year(v).cast("string")
            return (F.when(p["form"] == 0, F.concat_ws("-", y, mo, d)).when(p["form"] == 1, F.concat_ws(".", d, mo, y))
                    .when(p["form"] == 2, F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws("/", d, mo, y)))

        return F.when(p.isNotNull(), _bound(walked, printed))

    return _bound(_read_date(m), changed)


def _phone(m: Column, secret: str) -> Column:
    """The national digits are permuted, in any spelling of a number alike; a trunk prefix (0) stays.

    An American number, with or without +1, stays one: its area code and exchange begin with 2 to 9.
    Of other numbers the first national digit, which tells the kind of line, stays.
    """
    bare = F.replace(m, F.lit("(0)"), F.lit("(#)"))
    digits = _digits(bare)
    code = F.when(~m.startswith("+"), F.greatest(F.length(digits) - 10, F.lit(0))).otherwise(
        F.when(digits.rlike(f"^{SHORT_CODES}"), F.length(F.regexp_extract(digits, f"^{SHORT_CODES}", 0))).otherwise(3))

    def changed(p: Column) -> Column:
        country, national = F.substr(p["digits"], F.lit(1), p["code"]), F.substr(p["digits"], p["code"] + 1, F.length(p["digits"]))
        american = ((p["code"] == 0) | (country == "1")) & national.rlike(r"^[2-9]\d\d[2-9]\d{6}$")
        place = lambda at, n: F.substring(national, at, n).cast("bigint")
        value = ((place(1, 3) - 200) * 100 + place(7, 2)) * AMERICAN[1] + (place(4, 3) - 200) * 100 + place(9, 2)

        def dialled(v: Column) -> Column:
            left, right = F.floor(v / AMERICAN[1]), v % AMERICAN[1]
            ends = F.lpad((left % 100).cast("string"), 2, "0"), F.lpad((right % 100).cast("string"), 2, "0")
            return F.concat((F.floor(left / 100) + 200).cast("string"), (F.floor(right / 100) + 200).cast("string"), *ends)

        whole = _bound(permuted_number(value, AMERICAN, secret, "phone"), dialled)
        # a ten-digit number that is no American one keeps what makes it none
        kept = F.when((p["code"] == 0) | (country == "1"), F.concat(
            F.substring(national, 1, 1), _bound(permuted_text(F.concat(F.substring(national, 2, 2), F.substr(
                national, F.lit(5), F.length(national))), secret, "phone"), lambda t: F.concat(
                    F.substring(t, 1, 2), F.substring(national, 4, 1), F.substr(t, F.lit(3), F.length(t)))))).otherwise(
            F.concat(F.substring(national, 1, 1), permuted_text(F.substr(national, F.lit(2), F.length(national)), secret, "phone")))
        return F.when(F.length(p["digits"]).between(8, 15), F.concat(country, F.when(american, whole).otherwise(kept)))

    new = _bound(F.struct(digits.alias("digits"), code.alias("code")), changed)
    return F.replace(refilled(bare, new), F.lit("(#)"), F.lit("(0)"))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}


def pseudonym(match: Column, secret: str) -> Column:
    """Pseudonym of a match by the first kind that it fits and under which it is valid; else itself."""
    tries = [F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), make(match, secret)) for kind, make in _MAKERS.items()]
    return F.coalesce(*tries, match)


def pseudonymise(docs: DataFrame, secret: str = "key", text: str = "text") -> DataFrame:
    """The table with personal data in its text replaced, and a column that counts the changes.

    The count is called `n_replaced`, with underscores in front if that name is taken. Null
    texts stay null and count 0; equal rows give equal rows; an empty table stays empty.
    """
    count, found = fresh(docs, "n_replaced"), fresh(docs, "_found")
    body = F.col(text).cast("string")
    matches = F.regexp_extract_all(body, F.lit(ANY), 0)
    new = F.transform(matches, lambda m: F.struct(m.alias("old"), pseudonym(m, secret).alias("new")))
    marked = docs.withColumn(found, F.when(body.rlike(HINT) & body.rlike(ANY), new))
    between = F.split(body, ANY, -1)
    joined = F.array_join(F.zip_with(between, F.col(found), lambda part, v: F.concat(
        part, F.coalesce(v["new"], F.lit("")))), "")
    changed = F.filter(F.col(found), lambda v: v["old"] != v["new"])
    columns = [F.when(F.col(found).isNull(), body).otherwise(joined).alias(text) if c == text else F.col(f"`{c}`")
               for c in docs.columns]
    return marked.select(*columns, F.coalesce(F.size(changed), F.lit(0)).alias(count))
