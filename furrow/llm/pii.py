"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations alone.

A text is split at everything that looks like an e-mail address, IPv4 address, IBAN, date, social security number,
phone or payment card number. What passes its kind's validation (octets, mod 97, calendar, ranges, Luhn) is replaced by a keyed
permutation of its own format: an alternating Feistel network shifts every digit within 0-9 and every letter within
its case by a hash of the key, the kind, the round and the other half. Separators, country codes and mail domains stay, check digits are
made anew, and dates and social security numbers walk along the permutation's cycle to the next valid value. Equal
values therefore get equal pseudonyms in all documents, different values different ones, and the key undoes nothing
without the network. Everything else, invalid numbers too, stays as it is.

Defined results: null texts stay null and empty ones empty, with nothing found; rows with the same id are treated each for itself; an
empty table gives no rows; a very long text is searched and put together whole in its row; other columns are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import carried

ROUNDS = 8
#: Steps along a cycle until a valid value; at most 4 in 10 values of these kinds' domains are invalid, so a walk that long has a chance of 1e-16.
WALK = 40
KINDS = ("email", "ipv4", "iban", "date", "ssn", "phone", "card")

#: The countries that issue IBANs, by the length of theirs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes whose numbers all have as many digits after them.
PHONE_CODES = {9: "31|32|33|34|41|48|61", 10: "1|7|44|90|91", 11: "86"}


def _iban_of(length: int) -> str:
    """Of one length; spaces may stand before each four characters."""
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{IBAN_COUNTRIES[length].replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + rf" ?[A-Z0-9]{{{rest}}}" * bool(rest)


def _phone_of(count: int) -> str:
    """Of country codes with numbers of `count` digits, in groups of any kind."""
    return rf"\+(?:{PHONE_CODES[count]})(?:[ .-]?[ (]?[0-9]\)?){{{count}}}(?![0-9])"


#: Between digits of a number: before two digits at least, and not before a date; after nine digits also not by a space where hyphens or points led up to it.
_GAP = r"(?![ .-]?(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9]))(?:\)[ .-]?|[ .-]\(?|\()(?=[0-9]{2})"
_FIXED = "|".join(map(_phone_of, PHONE_CODES))
_GROUPED = rf"\+[0-9](?:(?:{_GAP})?[0-9]){{6,8}}(?:(?:(?!(?<=[.-][0-9]{{2,4}}) ){_GAP})?[0-9]){{0,6}}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{'|'.join(map(_iban_of, IBAN_COUNTRIES))})(?![A-Za-z0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": rf"(?<![0-9A-Za-z])(?:{_FIXED}|{_GROUPED}|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|(?<!\.)[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}}(?!\.[0-9]))(?![0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
}
EVERYTHING = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates are permuted among the days from the first to the last; the two radices give little more than their number.
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS, DAY_RADICES = 73049, (271, 270)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value bound, so that it is made once."""
    return F.transform(F.array(value), use)[0]


def feistel(values: Column, radices: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of arrays of numbers, each staying below its radix."""
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    begin = F.struct(F.slice(values, 1, half).alias("a"), F.slice(values, half + 1, rest).alias("b"), F.slice(radices, 1, half).alias("ra"), F.slice(radices, half + 1, rest).alias("rb"))

    def step(s: Column, r: Column) -> Column:
        seed = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), F.array_join(s["b"], ",")), 256)
        moved = let(seed, lambda h: F.zip_with(F.transform(s["a"], lambda x, i: x.cast("long") + F.pmod(F.xxhash64(h, i), F.lit(1 << 40))), s["ra"], lambda x, r: F.pmod(x, r.cast("long")).cast("int")))
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    # Each round moves one half and swaps; after an even number of rounds both are in their places.
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: F.concat(s["a"], s["b"]))


def characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substring(text, i, F.lit(1)))


def permuted_text(text: Column, free: Callable[[Column], Column], key: str, tweak: str) -> Column:
    """The characters at places i (from 0) with free(i) permuted, digits among digits, letters in their case; others stay."""

    def apply(chars: Column) -> Column:
        def coded(c: Column, i: Column) -> Column:
            code = F.ascii(c)
            base = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
            base = F.when(free(i), base)
            return F.struct(c.alias("c"), base.alias("base"), F.coalesce(code - base, F.lit(0)).alias("value"), F.when(base == 48, 10).when(base.isNotNull(), 26).otherwise(1).alias("radix"))

        def back(codes: Column) -> Column:
            # Only free characters take part, so that fixed ones don't halve the network's width.
            taking = F.filter(codes, lambda x: x["radix"] > 1)
            return let(taking, lambda t: let(
                feistel(F.transform(t, lambda x: x["value"]), F.transform(t, lambda x: x["radix"]), key, tweak),
                lambda new: F.aggregate(codes, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, x: F.when(
                    x["radix"] > 1, F.struct(F.concat(s["out"], F.char(x["base"] + F.get(new, s["at"]))).alias("out"), (s["at"] + 1).alias("at"))
                ).otherwise(F.struct(F.concat(s["out"], x["c"]).alias("out"), s["at"].alias("at"))), lambda s: s["out"]),
            ))

        return let(F.transform(chars, coded), back)

    return let(characters(text), apply)


def digits(text: Column) -> Column:
    return F.transform(characters(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(numbers: Column) -> Column:
    """The Luhn sum of an array of digits, the last being the check digit."""

    def weighed(d: Column, i: Column) -> Column:
        doubled = (F.size(numbers) - 1 - i) % 2 == 1
        return F.when(doubled, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(numbers, weighed), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """The number that a text of digits and capital letters (A = 10) stands for, modulo 97."""

    def add(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(characters(text), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    last = F.char_length(m) - 1
    moved = permuted_text(m, lambda i: i < last, key, "card")

    def checked(t: Column) -> Column:
        head = F.substring(t, F.lit(1), last)
        check = F.pmod(10 - luhn_sum(digits(F.concat(head, F.lit("0")))), F.lit(10))
        return F.concat(head, check.cast("string"))

    return F.when(let(digits(m), luhn_sum) % 10 == 0, let(moved, checked))


def _iban(m: Column, key: str) -> Column:
    def compact(t: Column) -> Column:
        return F.replace(t, F.lit(" "), F.lit(""))

    def turned(t: Column, check: Column) -> Column:
        return F.concat(F.substring(t, F.lit(5), F.char_length(t)), F.substring(t, F.lit(1), F.lit(2)), check)

    size = F.char_length(compact(m))
    valid = size.between(15, 34) & (let(compact(m), lambda t: mod97(turned(t, F.substring(t, F.lit(3), F.lit(2))))) == 1)
    moved = permuted_text(m, lambda i: i > 3, key, "iban")
    check = let(moved, lambda t: F.lpad((98 - let(compact(t), lambda c: mod97(turned(c, F.lit("00"))))).cast("string"), 2, "0"))
    return F.when(valid, F.concat(F.substring(m, F.lit(1), F.lit(2)), check, F.substring(moved, F.lit(5), F.char_length(m))))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    return let(octets, lambda o: F.array_join(feistel(o, F.transform(o, lambda _: F.lit(256)), key, "ipv4"), "."))


def _walk(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The first valid value after start along step's cycle."""
    first = step(start)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(valid(v), v).otherwise(step(v)))


def _date(m: Column, key: str) -> Column:
    """Year first, or year last with the day first where the month can't be first (13-31), else the month."""
    parts = F.transform(F.split(m, r"[/.-]"), lambda p: p.cast("int"))

    def made(p: Column) -> Column:
        iso = m.contains("-")
        day_first = ~iso & ((F.get(p, 0) > 12) | m.contains("."))
        year = F.when(iso, F.get(p, 0)).otherwise(F.get(p, 2))
        month = F.when(iso | day_first, F.get(p, 1)).otherwise(F.get(p, 0))
        day = F.when(iso, F.get(p, 2)).when(day_first, F.get(p, 0)).otherwise(F.get(p, 1))
        text = F.format_string("%04d-%02d-%02d", year, month, day)
        number = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))

        def step(n: Column) -> Column:
            halves = F.array((n / DAY_RADICES[1]).cast("int"), n % DAY_RADICES[1])
            moved = feistel(halves, F.array(*[F.lit(r) for r in DAY_RADICES]), key, "date")
            return let(moved, lambda h: F.get(h, 0) * DAY_RADICES[1] + F.get(h, 1))

        def valid(v: Column) -> Column:
            # A slashed date shows that the day is first only by a day over 12: such dates are permuted among themselves.
            late = F.day(F.date_add(F.lit(FIRST_DAY).cast("date"), v)) > 12
            return (v < DAYS) & (late | ~(day_first & m.contains("/")))

        new = let(number, lambda n: _walk(n, step, valid))

        def shown(n: Column) -> Column:
            date = F.date_add(F.lit(FIRST_DAY).cast("date"), n)
            y, mo, d = F.year(date), F.month(date), F.day(date)
            mark = F.substring(m, F.lit(3), F.lit(1))
            late = F.when(day_first, F.format_string("%02d%s%02d%s%04d", d, mark, mo, mark, y)).otherwise(F.format_string("%02d%s%02d%s%04d", mo, mark, d, mark, y))
            return F.when(iso, F.format_string("%04d-%02d-%02d", y, mo, d)).otherwise(late)

        return F.when(number.between(0, DAYS - 1), let(new, shown))

    return let(parts, made)


def _ssn(m: Column, key: str) -> Column:
    def valid(t: Column) -> Column:
        return ~t.rlike("^(000|666|9..)-|-00-|-0000$")

    return F.when(valid(m), _walk(m, lambda t: permuted_text(t, lambda i: F.lit(True), key, "ssn"), valid))


def _phone(m: Column, key: str) -> Column:
    code = F.char_length(F.regexp_extract(m, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])", 0))
    return F.when(F.size(digits(m)).between(7, 15), permuted_text(m, lambda i: i >= code, key, "phone"))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return permuted_text(m, lambda i: i < at - 1, key, "email")


MAKERS = {"email": _email, "ipv4": _ipv4, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """(kind, value) of one match; both null where validation fails."""
    value = kind = None
    for name in KINDS:
        is_kind, made = match.rlike(f"^(?:{PATTERNS[name]})$"), MAKERS[name](match, key)
        value = F.when(is_kind, made) if value is None else value.when(is_kind, made)
        kind = F.when(is_kind, name) if kind is None else kind.when(is_kind, name)
    return let(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value")))


def replaced(text: Column, key: str) -> Column:
    """A struct of the text with pseudonyms and the array of the kinds found, in their order."""

    def join(found: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(EVERYTHING), F.lit(0))
        pairs = F.zip_with(matches, found, lambda m, f: F.coalesce(f["value"], m))
        pieces = F.zip_with(F.split(text, EVERYTHING, -1), pairs, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))
        return F.struct(F.array_join(F.flatten(pieces), "").alias("text"), F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    found = F.transform(F.regexp_extract_all(text, F.lit(EVERYTHING), F.lit(0)), lambda m: pseudonym(m, key))
    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike("[0-9@]"), let(found, join)).otherwise(nothing)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Every row as `row`, with text (the original with pseudonyms) and kinds (of what was replaced)."""
    rows = carried(docs, done=replaced(docs[text_col], key))
    return rows.select("row", F.col("done.text").alias("text"), F.col("done.kinds").alias("kinds"))
