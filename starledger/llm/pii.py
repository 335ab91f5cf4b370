"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern and validated: e-mail addresses, phone numbers, payment card numbers
(Luhn), IBANs (mod 97, by their country's length), US social security numbers, IPv4 and IPv6 addresses,
calendar dates (also before a time of day), hexadecimal tokens and access keys. A phone number behind a
calling code takes no more digits than that country's numbers have, so what follows stays outside. Each valid one is replaced by a keyed Feistel permutation within its
format: digits stay digits, card numbers stay valid card numbers, addresses stay addresses, dates stay
dates written alike. The same value gets the same pseudonym in every document, however it is written
(a card with or without spaces, a date in any order, a phone number with or without signs, a mail name in any case, an IPv6 address with or without a gap), and
different values get different ones. Who knows the key can undo it, so it has no default.

One pass of the patterns, no shuffle, nothing collected; every pattern matches a bounded number of
characters, so time is linear in a text's length and very long texts are whole texts like others. Null
texts stay null, empty ones empty; text outside valid values stays as it is. Equal rows give equal rows,
an empty table an empty one; other columns pass through.

The permutations are Feistel networks of 8 rounds whose round function is SHA-256 over key, kind,
round and the other half. Character formats add a keystream to one half, position by position within
its class (digits, small letters, capitals); dates and addresses run over a product of two ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8

# Lengths of account numbers by country, and of phone numbers behind a calling code (the longest).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
PHONE_LENGTHS = {"1": 10, "7": 10, "31": 9, "32": 9, "33": 9, "34": 9, "36": 9, "39": 11, "41": 9, "43": 13, "44": 10, "45": 8, "46": 9, "47": 8, "48": 9, "49": 11, "52": 10, "55": 11, "61": 9, "81": 10, "82": 10, "86": 11, "90": 10, "91": 10}
# The patterns, in the order in which they are tried at a place; country calling codes of
# one or two digits (all others have three); the days after the 28th that every year has.
_GROUPS = "|".join(rf"(?:{country.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, country in IBAN_LENGTHS.items())
_ACCOUNT = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_SIGNS = "[ .()-]{0,2}"
_CALL = "|".join(rf"{code}(?:{_SIGNS}\d){{{10 if code == '1' else 6},{n}}}" for code, n in PHONE_LENGTHS.items())
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "key": r"\b(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{16}\b",
    "token": r"\b(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})\b",
    "iban": rf"\b(?:{_GROUPS}|(?!{_ACCOUNT})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)\b",
    "phone": rf"(?<![\w+])\+(?:{_CALL}|(?!1)\d(?:{_SIGNS}\d){{6,14}})(?!\d)|(?<!\w)(?<!\d[.-])\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}(?!\w|-\d)|(?<![\w+])(?<!\d[.-])0[1-9]\d{{1,3}}[ /-](?:\d{{5,8}}|\d{{3,4}}[ -]\d{{3,5}}|\d{{3}}[ -]\d{{2}}[ -]\d{{2}})(?!\w|[.-]\d)",
    "ssn": r"(?<!\w)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    "date": r"(?<!\w)(?<!\d[./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?=T\d{2}:)|(?!\w|[./-]\d))",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "ip6": rf"(?<![\w:])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])",
    "card": r"(?<!\w)(?<!\d-)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w|-\d)",
}
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
LATE_DAYS = [100 * m + d for m in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) for d in (29, 30, 31) if d < 31 or m in (1, 3, 5, 7, 8, 10, 12)]
# End of fixed values.
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds none of the values.
_HINT = r"@|\d|[0-9A-Fa-f]:"
#: Stands before and after each found value; in the text itself it and its escape are escaped.
_MARK, _ESCAPE, _OTHER = "\ue000", "\ue001", "\ue002"


def _prf(key: str, kind: str | Column, r: Column, half: Column) -> Column:
    """SHA-256 of key, kind, round and half, in hexadecimal."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half), 256)


def _rounds(state: Column, first: Callable[[Column, Column], Column], second: Callable[[Column, Column], Column]) -> Column:
    """The state (a, b) after all rounds: even ones give a new a, odd ones a new b, each from state and round."""
    keep = lambda s, a, b: F.struct(a.alias("a"), b.alias("b"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), state, lambda s, r: F.when(r % 2 == 1, keep(s, s["a"], second(s, r))).otherwise(keep(s, first(s, r), s["b"])))


def _number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 13), 16, 10).cast("bigint")


def _let(value: Column, use) -> Column:
    """``use(x)`` with x computed once: a binding as a one-element array."""
    return F.transform(F.array(value), use)[0]


def permute_pair(a: Column, b: Column, na: int | Column, nb: int | Column, key: str, kind: str | Column) -> Column:
    """A permutation of pairs in [0, na) x [0, nb), as a struct (a, b)."""
    state = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    add = lambda own, other, n, r: (own + _number(_prf(key, kind, r, other.cast("string")))) % n
    return _rounds(state, lambda s, r: add(s["a"], s["b"], na, r), lambda s, r: add(s["b"], s["a"], nb, r))


def _shift(half: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Each character moved within its class by a byte of the stream; signs stay."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        if hexadecimal:
            return F.lower(F.hex(F.pmod(F.conv(c, 16, 10).cast("int") + by, F.lit(16))))
        code = F.ascii(c)
        turn = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(n)))
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), moved), "")


def permute_text(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A permutation of all strings of one pattern of digits, small letters, capitals and signs, or of all hexadecimal ones of one length."""
    cut = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1, F.length(value)).alias("b"))
    state = _rounds(state, lambda s, r: _shift(s["a"], _prf(key, kind, r, s["b"]), hexadecimal), lambda s, r: _shift(s["b"], _prf(key, kind, r, s["a"]), hexadecimal))
    return _let(state, lambda s: F.concat(s["a"], s["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Luhn sum of a string of digits; ``doubled_first``: whether the digit at index 0 is doubled."""
    numbers = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: _let(c.cast("int") * F.when(F.pmod(i, F.lit(2)) == F.when(doubled_first, 0).otherwise(1), 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + d)


def _luhn_valid(value: Column) -> Column:
    return _let(_digits(value), lambda d: (F.length(d) >= 13) & (luhn_sum(d, F.length(d) % 2 == 0) % 10 == 0))


def _refill(form: Column, characters: Column, slot: str) -> Column:
    """``form`` with its characters of class ``slot`` replaced, in order, by ``characters``."""
    parts = F.split(form, f"(?={slot})|(?<={slot})")
    numbered = F.aggregate(
        F.filter(parts, lambda p: p != ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda s, p: F.when(p.rlike(f"^{slot}$"), F.struct(F.concat(s["out"], F.substr(characters, s["i"] + 1, F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], p).alias("out"), s["i"].alias("i"))),
    )
    return numbered["out"]


def _card(value: Column, key: str) -> Column:
    """The first digit (the network) stays, the check digit is computed anew."""

    def made(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(b, F.length(b) % 2 == 1) % 10, F.lit(10)).cast("string")))

    return _let(_digits(value), lambda d: _refill(value, made(d), "[0-9]"))


def _mod97(value: Column) -> Column:
    """Remainder of an IBAN's digits, its first four characters moved to the end."""
    moved = F.concat(F.substr(value, F.lit(5), F.length(value)), F.substr(value, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(value: Column, key: str) -> Column:
    """Country and layout stay, the account is permuted, the check digits are computed anew."""

    def made(v: Column) -> Column:
        account = permute_text(F.substr(v, F.lit(5), F.length(v)), key, "iban")
        return _let(account, lambda a: F.concat(F.substr(v, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - _mod97(F.concat(F.substr(v, F.lit(1), F.lit(2)), F.lit("00"), a))).cast("string"), 2, "0"), a))

    return _let(F.regexp_replace(value, " ", ""), lambda v: _refill(value, made(v), "[0-9A-Z]"))


def _phone(value: Column, key: str) -> Column:
    """The country's code, after a plus sign, and the layout stay; the other digits are permuted. A number of three digits, three and four keeps both first digits in 2 to 9, as the numbering plan asks."""
    country = F.when(value.startswith("+"), F.regexp_extract(_digits(value), COUNTRY, 0)).otherwise("")

    def made(d: Column) -> Column:
        first, second = (F.substr(d, F.lit(i), F.lit(1)).cast("int") for i in (1, 4))
        moved = permute_pair(F.pmod(first - 2, F.lit(8)) * 8 + F.pmod(second - 2, F.lit(8)), F.concat(F.substr(d, F.lit(2), F.lit(2)), F.substr(d, F.lit(5), F.lit(6))).cast("bigint"), 64, 10**8, key, "phone")
        plan = _let(_let(moved, lambda s: F.struct(s["a"].alias("a"), F.lpad(s["b"].cast("string"), 8, "0").alias("b"))), lambda s: F.concat((F.floor(s["a"] / 8) + 2).cast("string"), F.substr(s["b"], F.lit(1), F.lit(2)), (s["a"] % 8 + 2).cast("string"), F.substr(s["b"], F.lit(3), F.lit(6))))
        return F.when(d.rlike("^[2-9]\\d\\d[2-9]\\d{6}$"), plan).otherwise(permute_text(d, key, "phone"))

    return _let(country, lambda c: _refill(value, F.concat(c, _let(F.substr(_digits(value), F.length(c) + 1, F.length(value)), made)), "[0-9]"))


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 665 or 667 to 899, group 01 to 99, serial 0001 to 9999, permuted among such numbers."""
    area, group, serial = (F.substring(value, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    moved = permute_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    return _let(moved, lambda s: F.concat_ws("-", F.lpad((s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))


def _ip(value: Column, key: str) -> Column:
    octet = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))

    def made(o: Column) -> Column:
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return _let(pair, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))

    return _let(octet, made)


def _groups6(value: Column) -> Column:
    """The written groups of an IPv6 address, before and behind the gap for zeros."""
    return F.filter(F.split(value, ":"), lambda g: g != "")


def _ip6(value: Column, key: str) -> Column:
    """Eight groups of four small hexadecimal digits, also for an address written with a gap."""
    zeros = F.array_join(F.array_repeat(F.lit("0:"), F.lit(8) - F.size(_groups6(value))), "")
    whole = F.when(value.contains("::"), F.replace(value, F.lit("::"), F.concat(F.lit(":"), zeros))).otherwise(value)
    full = F.array_join(F.transform(_groups6(F.lower(whole)), lambda g: F.lpad(g, 4, "0")), "")
    return F.regexp_replace(permute_text(full, key, "ip6", hexadecimal=True), "(.{4})(?!$)", "$1:")


def _access_key(value: Column, key: str) -> Column:
    return F.concat(F.substr(value, F.lit(1), F.lit(4)), permute_text(F.substr(value, F.lit(5), F.lit(16)), key, "key"))


def _leap(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def _real_day(y: Column, m: Column, d: Column) -> Column:
    last = F.when(m == 2, F.when(_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


def _date_of(value: Column) -> Column:
    """Year, month and day that a value of pattern ``date`` writes, or null. Slashes: month first, unless that is no date; points: day first."""
    number = lambda i, n: F.substr(value, F.lit(i), F.lit(n)).cast("int")
    day = lambda y, m, d: F.when(_real_day(y, m, d), F.struct(y.alias("y"), m.alias("m"), d.alias("d")))
    iso, month_first, day_first = day(number(1, 4), number(6, 2), number(9, 2)), day(number(7, 4), number(1, 2), number(4, 2)), day(number(7, 4), number(4, 2), number(1, 2))
    return F.when(value.substr(5, 1) == "-", iso).when(value.contains("/"), F.coalesce(month_first, day_first)).otherwise(day_first)


def _date(value: Column, key: str) -> Column:
    """A day of the same two centuries (1900 to 2099 and so on), written in the same order.

    Days to the 12th, from the 13th to the 28th, later ones, and leap days are permuted among themselves.
    So a day that shows which number in slashes is the month becomes another such day.
    """

    days = F.array(*[F.lit(x) for x in LATE_DAYS])

    def place(t: Column) -> Column:
        """The kind of day, its place (a, b) among the na x nb of its kind, and the first year of the two centuries."""
        y, m, d = t["y"], t["m"], t["d"]
        century = 1900 + 200 * F.floor((y - 1900) / 200)
        first, last = F.greatest(F.lit(1), century), F.least(F.lit(9999), century + 199)
        years, month = last - first + 1, (y - first) * 12 + m - 1
        # The first year of two centuries is never a leap year; the hundredth is one in each fourth century.
        number = (y - century) / 4
        leap = F.when(century < 0, number - 26).when((number > 25) & ((century + 100) % 400 != 0), number - 2).otherwise(number - 1)
        rows, columns = (F.when(years < 200, x).when((century + 100) % 400 == 0, 7).otherwise(z) for x, z in ((4, 6), (6, 8)))

        def of(kind: str, a: Column, b: Column, na: Column, nb: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), *[x.cast("bigint").alias(n) for x, n in ((a, "a"), (b, "b"), (na, "na"), (nb, "nb"), (first, "first"), (century, "century"))])

        return (
            F.when(d <= 12, of("date.early", month, d - 1, years * 12, F.lit(12)))
            .when(d <= 28, of("date.middle", month, d - 13, years * 12, F.lit(16)))
            .when(m == 2, of("date.leap", F.floor(leap / columns), leap % columns, rows, columns))
            .otherwise(of("date.late", y - first, F.array_position(days, 100 * m + d) - 1, years, F.lit(len(LATE_DAYS))))
        )

    def moved(p: Column) -> Column:
        return _let(permute_pair(p["a"], p["b"], p["na"], p["nb"], key, p["kind"]), lambda s: day(p, s["a"], s["b"]))

    def day(p: Column, a: Column, b: Column) -> Column:
        kind, index = p["kind"], a * p["nb"] + b
        number = F.when(p["century"] < 0, index + 26).when((index >= 24) & (p["nb"] == 8), index + 2).otherwise(index + 1)
        late = F.element_at(days, F.when(kind == "date.late", b + 1).otherwise(1).cast("int"))
        y = F.when(kind == "date.leap", p["century"] + 4 * number).when(kind == "date.late", p["first"] + a).otherwise(p["first"] + F.floor(a / 12))
        m = F.when(kind == "date.leap", 2).when(kind == "date.late", F.floor(late / 100)).otherwise(a % 12 + 1)
        d = F.when(kind == "date.leap", 29).when(kind == "date.late", late % 100).when(kind == "date.early", b + 1).otherwise(b + 13)
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    text = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def written(t: Column) -> Column:
        y, m, d = text(t["y"], 4), text(t["m"], 2), text(t["d"], 2)
        month_first = _real_day(*(F.substr(value, F.lit(i), F.lit(n)).cast("int") for i, n in ((7, 4), (1, 2), (4, 2))))
        return F.when(value.substr(5, 1) == "-", F.concat_ws("-", y, m, d)).when(value.contains("."), F.concat_ws(".", d, m, y)).when(month_first, F.concat_ws("/", m, d, y)).otherwise(F.concat_ws("/", d, m, y))

    return _let(_let(_let(_date_of(value), place), moved), written)


def _email(value: Column, key: str) -> Column:
    """The name is permuted in small letters and gets its capitals again where they were; the domain and signs of the name stay in place."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def made(name: Column) -> Column:
        moved = permute_text(F.lower(name), key, "email")
        cased = _let(moved, lambda m: F.array_join(F.zip_with(letters(name), letters(m), lambda was, now: F.when(was.rlike("[A-Z]"), F.upper(now)).otherwise(now)), ""))
        return F.concat(F.when(name.rlike("[A-Z]"), cased).otherwise(moved), F.substr(value, F.length(name) + 1, F.length(value)))

    return _let(F.regexp_extract(value, "^[^@]+", 0), made)


def kind_of(value: Column) -> Column:
    """The kind of a found value, if it is valid as that, else null."""
    is_a = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    octets_valid = F.forall(F.split(value, r"\."), lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255) & ((F.length(x) == 1) | (F.substr(x, F.lit(1), F.lit(1)) != "0")))
    area = F.substring(value, 1, 3)
    return (
        F.when(is_a("email"), "email")
        .when(is_a("key"), "key")
        .when(is_a("token"), "token")
        .when(is_a("iban"), F.when(_mod97(F.regexp_replace(value, " ", "")) == 1, "iban"))
        .when(is_a("phone"), F.when(F.length(_digits(value)).between(7, 15), "phone"))
        .when(is_a("ssn"), F.when(~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000"), "ssn"))
        .when(is_a("date"), F.when(_date_of(value).isNotNull(), "date"))
        .when(is_a("ip"), F.when(octets_valid, "ip"))
        .when(is_a("ip6"), F.when(~value.contains("::") | value.rlike("[0-9]") & (F.size(_groups6(value)).between(2, 7)), "ip6"))
        .when(is_a("card"), F.when(_luhn_valid(value), "card"))
    )


def _made(value: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "iban": _iban, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "ip6": _ip6, "card": _card, "key": _access_key, "token": lambda v, k: permute_text(v, k, "token", hexadecimal=True)}
    out = F.when(kind.isNull(), value)
    for name, f in made.items():
        out = out.when(kind == name, f(value, key))
    return out


def pseudonym(value: Column, key: str) -> Column:
    """A found value's pseudonym; the value itself where it is not valid."""
    return _let(kind_of(value), lambda k: _made(value, k, key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_values`` (valid values replaced); an input column of that name is replaced."""
    names = [c for c in docs.columns if c.lower() != "n_values"]
    parts, made = fresh(docs, "_parts", "_made")
    escaped = F.replace(F.replace(F.col(text), F.lit(_ESCAPE), F.lit(_ESCAPE + _OTHER)), F.lit(_MARK), F.lit(_ESCAPE + _ESCAPE))
    marked = F.regexp_replace(escaped, _ANY, f"{_MARK}$0{_MARK}")
    # Every second part is a found value.
    staged = docs.select(*names, F.when(F.col(text).rlike(_HINT), F.split(marked, _MARK, -1)).alias(parts))
    kinds = staged.withColumn(parts, F.when(F.size(parts) > 1, F.transform(parts, lambda p, i: F.struct(p.alias("said"), F.when(i % 2 == 1, kind_of(p)).alias("kind")))))
    renamed = kinds.withColumn(made, F.transform(parts, lambda x: _made(x["said"], x["kind"], key)))
    joined = F.array_join(F.col(made), "")
    rebuilt = F.replace(F.replace(joined, F.lit(_ESCAPE + _ESCAPE), F.lit(_MARK)), F.lit(_ESCAPE + _OTHER), F.lit(_ESCAPE))
    return renamed.select(
        *[F.when(F.col(made).isNotNull(), rebuilt).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in names],
        F.coalesce(F.size(F.filter(parts, lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long").alias("n_values"),
    )
