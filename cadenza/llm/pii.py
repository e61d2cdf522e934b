"""Format-preserving pseudonyms: validated numbers, dates and addresses, permuted by keyed Feistel rounds.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.bind import let

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DATE = "(?:" + "|".join(f"[0-9]{{4}}{m}(?:0[1-9]|1[0-2]){m}(?:0[1-9]|[12][0-9]|3[01])" for m in ("-", "/", r"\.")) + "|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})"
#: With a country code any area and a long last group are taken; without one the area is bracketed or begins with 2 to 9.
_PHONE = "|".join((
    r"(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])|\([0-9]{3}\) ?|[2-9][0-9]{2}[ .\-])[0-9]{3}[ .\-][0-9]{4}",
    r"\+[0-9]{7,15}",
    r"(?=\+(?:[ .\-()]{0,2}[0-9]){7})\+[0-9]{1,3}(?:[ .\-]?\([0-9]{1,5}\)[ .\-]?|[ .\-])(?:[0-9]{1,5}[ .\-]){0,4}[0-9]{2,10}",
    r"\+[0-9]{1,3}(?:[ .\-][0-9]{2,4}){2,4}",
))
#: Country codes of telephone numbers.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: A label that can end a domain. Repeated groups of labels are possessive, as Java's regular expressions else recurse once a repetition.
_TOP = "[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: The form of each kind; in a text the first that fits counts. Only email has @, only ipv6 a colon; a capital starts an iban only, a small letter an ibanlow.
FORMS = {
    "email": rf"(?<![\p{{L}}0-9._%+-])[\p{{L}}0-9._%+-]++@[A-Za-z0-9-]++(?:(?:\.(?!{_TOP})[A-Za-z0-9-]++)*+\.{_TOP})++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": rf"(?<![0-9/.\-]){_DATE}(?![0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]*[0-9])(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "spaced": r"(?<=(?i:ssn|social security|social security number|social security no\.)[ :#]{1,3})(?!000|666|9)[0-9]{3} (?!00)[0-9]{2} (?!0000)[0-9]{4}(?![0-9\-])",
    "ibanlow": r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}(?:[a-z0-9]{11,30}|(?: [a-z0-9]{4}){2,7}(?: [a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])(?:" + _PHONE + r")(?![0-9]|(?:\.[0-9]{1,3}){3}|[/.][0-9]{1,2}[/.][0-9]{4})",
}
#: Not within longer runs of digits, as parts of cards and IBANs look like it.
FORMS["national"] = r"(?<![0-9+])(?<![0-9A-Z][ \-])0[0-9]{2,4}[ \-][0-9]{3,4}[ \-][0-9]{4}(?![0-9]|[ \-][0-9])"
#: No date, SSN, IP or phone number begins within a card or an IBAN.
_APART = "(?!" + "|".join(f"(?:{FORMS[k]})" for k in ("date", "ssn", "ip", "phone")) + ")"
FORMS["iban"] = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: APART)?[A-Z0-9]{4}){2,7}(?:(?: APART)?[A-Z0-9]{1,3})?(?![A-Za-z0-9])".replace("APART", _APART)
FORMS["card"] = r"(?<![0-9])[0-9](?:(?:[ \-]APART)?[0-9]){12,18}(?![0-9])".replace("APART", _APART)
#: A match alone, without what stands before it.
ALONE = FORMS | {"spaced": "[0-9]{3} [0-9]{2} [0-9]{4}"}
PATTERN = "|".join(f"(?:{p})" for p in ALONE.values())
#: Where a card or an IBAN may begin, a match goes on over all that could belong to it or to a value after it; see _resolved.
#: Possessive, as Java's regular expressions else recurse once a repetition; it stops before an e-mail address.
_NO_MAIL = r"(?![A-Za-z0-9._%+\-]{0,64}@)"
_TAIL = rf"(?:[ \-./()+]{{0,3}}{_NO_MAIL}(?:[0-9]++|[A-Z]++(?![a-z])))*+"
RUNS = {
    "iban": rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:(?: {_NO_MAIL})?[A-Z0-9]){{11}}" + _TAIL,
    "card": rf"(?<![0-9])[0-9](?:(?:[ \-]{_NO_MAIL})?[0-9]){{12}}[0-9]*+" + _TAIL,
}
SEARCH = "|".join(f"(?:{RUNS.get(k, p)})" for k, p in FORMS.items())
#: The longest form is an IBAN of 34 characters with spaces; what follows is looked at too.
_WINDOW = 80
#: Days from 1800-01-01 to 2199-12-31, as a product: one Gregorian cycle.
DAYS, HIGH, LOW = 146_097, 189, 773


def _hashed(*parts: Column) -> Column:
    """60 bits of a SHA-256 of the parts."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(high: Column, low: Column, high_size: Column, low_size: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (high, low) below the sizes, as a struct of h and l."""
    tweak = F.concat_ws(":", F.lit(key), tweak, high_size.cast("string"), low_size.cast("string"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["l"]).otherwise(s["h"])
        move = _hashed(tweak, i.cast("string"), other.cast("string"))
        return F.struct(
            F.when(even, F.pmod(s["h"] + F.pmod(move, high_size), high_size)).otherwise(s["h"]).alias("h"),
            F.when(even, s["l"]).otherwise(F.pmod(s["l"] + F.pmod(move, low_size), low_size)).alias("l"),
        )

    start = F.struct(high.cast("long").alias("h"), low.cast("long").alias("l"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the digit strings of equal length (up to 36 digits)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    first = F.concat(F.lit("0"), F.substring(digits, F.lit(1), half)).cast("long")
    rest = F.substring(digits, half + 1, n - half).cast("long")
    done = feistel(first, rest, size(half), size(n - half), key, tweak)
    return let(done, lambda s: F.concat(F.when(half > 0, F.lpad(s["h"].cast("string"), half, "0")).otherwise(""), F.lpad(s["l"].cast("string"), n - half, "0")))


#: Small and capital letters beyond a to z: Latin-1 and the basic Cyrillic and Greek alphabets.
_ALPHABETS = [x for first, last in ((0xE0, 0xF6), (0x430, 0x44F), (0x3B1, 0x3C1)) for x in ("".join(map(chr, range(first, last + 1))), "".join(map(chr, range(first, last + 1))).upper())]


def _moved(char: Column, by: Column) -> Column:
    """The character by so many places on in its class (digits, small or capital letters of an alphabet); others stay."""
    code = F.ascii(char)
    within = lambda alphabet: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), char) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
    other = char
    for alphabet in _ALPHABETS:
        other = F.when(F.instr(F.lit(alphabet), char) > 0, within(alphabet)).otherwise(other)
    turn = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
    return F.when(char.rlike("^[0-9]$"), turn(48, 10)).when(char.rlike("^[a-z]$"), turn(97, 26)).when(char.rlike("^[A-Z]$"), turn(65, 26)).when(char.rlike(r"^\p{L}$"), other).otherwise(char)


def permuted_letters(text: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of strings in which each character stays of its class (digit, small, capital)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        own, other = F.when(even, s["a"]).otherwise(s["b"]), F.when(even, s["b"]).otherwise(s["a"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, n.cast("string"), i.cast("string"), other), 256)
        moved = lambda d: F.transform(F.split(own, ""), lambda c, j: _moved(c, F.conv(F.substring(d, j * 2 % 60 + 1, F.lit(4)), 16, 10).cast("int")))
        new = F.array_join(let(digest, moved), "")
        return F.struct(F.when(even, new).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new).alias("b"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, n).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by those given, in order."""
    return let(digits, lambda d: _filled(form, d))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; doubled: 1 if the digits lack the check digit, so that the last one is doubled."""
    at = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when((i + doubled) % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(at, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """The remainder by 97 of the number in which A to Z stand for 10 to 35."""

    def step(s: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted_digits(F.substring(digits, F.lit(2), n - 2), key, F.concat(F.lit("card"), F.substring(digits, 1, 1))))
    checked = let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 1) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits, 0) % 10 == 0, _refilled(m, checked)).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = mod97(F.concat(account, F.substring(plain, 1, 4))) == 1
    check = lambda a: F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    whole = let(permuted_letters(account, key, F.concat(F.lit("iban"), country)), lambda a: F.concat(country, check(a), a))

    def spaced(w: Column) -> Column:
        step = lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(w, s["k"], F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k"))
        return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])

    return F.when(valid, let(whole, spaced)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial stay valid: 1 to 899 without 666, 1 to 99, 1 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    place = area - F.when(area > 666, 2).otherwise(1)  # 0 to 897
    done = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn"))
    mark = F.substring(m, 4, 1)
    write = lambda s: F.concat(F.lpad((s["h"] + F.when(s["h"] > 664, 2).otherwise(1)).cast("string"), 3, "0"), mark, F.lpad((F.floor(s["l"] / 9999) + 1).cast("string"), 2, "0"), mark, F.lpad((s["l"] % 9999 + 1).cast("string"), 4, "0"))
    return let(done, write)


def _ip(m: Column, key: str) -> Column:
    o = [F.split(m, "\\.")[k].cast("int") for k in range(4)]
    done = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"))
    write = lambda s: F.concat_ws(".", *(F.floor(x).cast("int").cast("string") for x in (s["h"] / 256, s["h"] % 256, s["l"] / 256, s["l"] % 256)))
    return let(done, write)


def _date(m: Column, key: str) -> Column:
    """The day is permuted within its 400 years, so the result is a day too; order of parts and marks stay."""
    iso = m.rlike("^[0-9]{4}[/.-]")
    part = F.split(m, "[/.-]")
    one, two, year = F.get(part, F.lit(0)).cast("int"), F.get(part, F.lit(1)).cast("int"), F.get(part, F.lit(2))
    swapped = ~iso & (two > 12)
    day, month = F.when(swapped, two).otherwise(one), F.when(swapped, one).otherwise(two)
    date = F.when(iso, F.regexp_replace(m, "[/.]", "-")).otherwise(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))).try_cast("date")
    n = F.datediff(date, F.lit("1800-01-01").cast("date"))
    cycle, at = F.floor(n / DAYS), F.pmod(n, F.lit(DAYS))
    done = feistel(F.floor(at / LOW), at % LOW, F.lit(HIGH).cast("long"), F.lit(LOW).cast("long"), key, F.lit("date"))

    def write(s: Column) -> Column:
        new = F.date_add(F.lit("1800-01-01").cast("date"), (cycle * DAYS + s["h"] * LOW + s["l"]).cast("int"))
        y = F.lpad(F.year(new).cast("string"), 4, "0")
        mark, mark2 = F.regexp_extract(m, "^[0-9]+([/.])", 1), F.regexp_extract(m, "([/.])[0-9]+$", 1)
        two_digits = lambda x: F.lpad(x.cast("string"), 2, "0")
        d, mo = two_digits(F.day(new)), two_digits(F.month(new))
        # A swapped date must still be read as one: its day stays above 12 or else it is written the other way.
        return F.when(iso, F.concat(y, F.substring(m, 5, 1), mo, F.substring(m, 5, 1), d)).when(swapped & (F.day(new) > 12), F.concat(mo, mark, d, mark2, y)).otherwise(F.concat(d, mark, mo, mark2, y))

    return F.coalesce(F.when(date.isNotNull() & F.year(date).between(1, 9999), let(done, write)), m)


def _phone(m: Column, key: str) -> Column:
    """Country code, a zero in brackets after it and the first digit of the number stay; the other digits are permuted.

    A number of ten digits without a country code counts as one of country 1, so a number gets one pseudonym in either form.
    """

    def of(digits: Column) -> Column:
        plus = m.startswith("+")
        code = F.when(plus, F.regexp_extract(digits, f"^({COUNTRY})", 1)).when((F.length(digits) == 10) & ~digits.startswith("0"), "1").otherwise("")
        trunk = F.when(plus & m.rlike(r"^\+[0-9 .\-]*\(0\)"), 1).otherwise(0)
        keep = F.when(plus, F.length(code)).otherwise(0) + trunk + 1
        head, first = F.substring(digits, F.lit(1), keep), F.substring(digits, keep, F.lit(1))
        tail = F.substring(digits, keep + 1, F.length(digits) - keep)
        return F.concat(head, permuted_digits(tail, key, F.concat_ws(":", F.lit("phone"), code, first)))

    return _refilled(m, let(_digits(m), of))


def _ipv6(m: Column, key: str) -> Column:
    """The first group stays, the other 112 bits are permuted; written in full."""

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def of(s: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.when(F.contains(m, F.lit("::")), 8 - F.size(s["a"]) - F.size(s["b"])).otherwise(0))
        return F.array_join(F.transform(F.concat(s["a"], zeros, s["b"]), lambda g: F.lpad(F.lower(g), 4, "0")), "")

    def write(digits: Column) -> Column:
        number = lambda a, n: F.conv(F.substring(digits, a, n), 16, 10).cast("long")
        half = F.lit(1 << 56)
        done = feistel(number(5, 14), number(19, 14), half, half, key, F.concat(F.lit("ipv6"), F.substring(digits, 1, 4)))
        hexed = let(done, lambda s: F.concat(F.substring(digits, 1, 4), F.lpad(F.hex(s["h"]), 14, "0"), F.lpad(F.hex(s["l"]), 14, "0")))
        return let(F.lower(hexed), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(h, k * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":"))

    parts = F.struct(groups(F.substring_index(m, "::", 1)).alias("a"), F.when(F.contains(m, F.lit("::")), groups(F.substring_index(m, "::", -1))).otherwise(F.array().cast("array<string>")).alias("b"))
    whole = let(parts, of)
    valid = m.rlike(f"^(?:{_GROUP}:){{7}}{_GROUP}$") | (F.size(F.filter(F.split(m, ":"), lambda g: g != "")) <= 7)
    return F.when(valid, let(whole, write)).otherwise(m)


def _iban_low(m: Column, key: str) -> Column:
    return F.lower(_iban(F.upper(m), key))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted_letters(F.substring(m, F.lit(1), at - 1), key, F.lit("email")), F.substring(m, at, F.length(m)))


_NEW = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "ipv6": _ipv6, "spaced": _ssn, "ibanlow": _iban_low, "phone": _phone, "national": _phone, "card": _card}


def kind_of(match: Column) -> Column:
    out = F.when(F.contains(match, F.lit("@")), "email").when(F.contains(match, F.lit(":")), "ipv6").when(match.rlike("^[A-Z]"), "iban").when(match.rlike("^[a-z]"), "ibanlow")
    for kind in ("date", "ssn", "spaced", "ip", "phone", "national"):
        out = out.when(match.rlike(f"^(?:{ALONE[kind]})$"), kind)
    return out.otherwise("card")


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself if its check digits or date are not valid."""
    kind = kind_of(match)
    out = F.when(kind == "email", _email(match, key))
    for k, f in _NEW.items():
        if k != "email":
            out = out.when(kind == k, f(match, key))
    return out


def _candidates(window: Column) -> Column:
    """What may be a value at the window's second character, long before short; the first character is the one before it."""
    form = lambda p: F.regexp_extract(window, f"(?s)^.({p})", 1)
    ibans = [form(rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:(?: {_APART})?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(34, 11, -1)]
    plain = [form(FORMS[k]) for k in ("date", "ssn", "ip", "phone")]
    cards = [form(rf"(?<![0-9])[0-9](?:(?:[ \-]{_APART})?[0-9]){{{n - 1}}}(?![0-9])") for n in range(19, 12, -1)]
    letter = F.substring(window, 2, 1).rlike("[A-Z]")
    return F.filter(F.when(letter, F.array(*ibans)).otherwise(F.array(*plain, *cards)), lambda c: c != "")


def _resolved(run: Column, key: str) -> Column:
    """A run with every valid value in it replaced, as a struct of text and n (how many).

    From left to right, at each place where a value may begin, candidates of all forms and lengths are validated
    first; the first valid one is taken and the search goes on behind it.
    """

    def walk(chars: Column) -> Column:
        size = F.size(chars)
        before = lambda k: F.when(k == 1, F.lit(" ")).otherwise(F.get(chars, k - 2))
        starts = F.filter(F.sequence(F.lit(1), size), lambda k: F.get(chars, k - 1).rlike("[A-Z0-9+(]") & ~(F.get(chars, k - 1).rlike("[A-Z0-9]") & before(k).rlike("[A-Z0-9]")))
        window = lambda k: F.concat(before(k), F.array_join(F.slice(chars, k, F.lit(_WINDOW)), ""))

        def step(s: Column, k: Column) -> Column:
            tried = lambda w: F.filter(F.transform(_candidates(w), lambda c: F.struct(c.alias("old"), pseudonym(c, key).alias("new"))), lambda c: c["old"] != c["new"])
            take = lambda v: F.struct(F.concat(s["text"], F.array_join(F.slice(chars, s["at"], k - s["at"]), ""), v["new"]).alias("text"), (s["n"] + 1).alias("n"), (k + F.length(v["old"])).alias("at"))
            found = let(window(k), lambda w: let(tried(w), lambda t: F.when(F.size(t) > 0, let(F.get(t, F.lit(0)), take)).otherwise(s)))
            return F.when(k < s["at"], s).otherwise(found)

        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(1).alias("at"))
        rest = lambda s: F.array_join(F.slice(chars, s["at"], F.greatest(size - s["at"] + 1, F.lit(0))), "")
        return F.aggregate(starts, start, step, lambda s: F.struct(F.concat(s["text"], rest(s)).alias("text"), s["n"].alias("n")))

    return let(F.split(run, ""), walk)


def replaced(match: Column, key: str) -> Column:
    """A match of SEARCH with its values replaced, as a struct of text and n."""
    whole = F.when(match.rlike(f"^(?:{PATTERN})$"), pseudonym(match, key)).otherwise(match)
    run = match.rlike(f"^(?:{RUNS['iban']}|{RUNS['card']})$")
    done = lambda new: F.when((new == match) & run, _resolved(match, key)).otherwise(F.struct(new.alias("text"), (new != match).cast("int").alias("n")))
    return let(whole, done)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every valid e-mail address, IBAN, date, social security, IP (4 and 6), phone and card number in the
    text replaced by a keyed pseudonym of the same form; count_col, if named, gets how many changed.

    Each value is permuted among the values of its form by Feistel rounds keyed with SHA-256, and check
    digits are made anew, so equal values get equal pseudonyms in all documents and different ones differ.
    Kept as they are: an address's domain, a card's first digit, a phone's country code and first digit,
    an IBAN's country, an IPv6 address's first group, separators. What looks like a number but fails its check stays. A social security number
    with spaces is taken only behind words that say so; a phone of a country other than 1 has one pseudonym only where its code is written.

    A null text stays null (count 0), an empty one empty; all rows and other columns stay, whatever their names. If docs has
    several columns named like the text, the first is taken as the text.
    """
    names = docs.columns
    at = names.index(text_col)
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text = F.col(f"c{at}")
    # Every form has a digit or an @; only texts with either are searched.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(SEARCH), F.lit(0)))
    rows = docs.withColumn("found", found).withColumn("new", F.transform("found", lambda m: replaced(m, key)))
    # one more piece than matches: the text between them, each followed by the new value
    pieces = F.zip_with(F.split(text, SEARCH, -1), "new", lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit(""))))
    out = [F.when(F.size("new") > 0, F.array_join(pieces, "")).otherwise(text) if k == at else F.col(f"c{k}") for k in range(len(names))]
    if count_col:
        out.append(F.when(F.size("new") > 0, F.aggregate("new", F.lit(0), lambda s, x: s + x["n"])).otherwise(0))
        names = [*names, count_col]
    return rows.select(*(c.alias(f"o{k}") for k, c in enumerate(out))).toDF(*names)
