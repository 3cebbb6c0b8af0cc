"""Format-preserving pseudonyms for personal data, in SQL expressions only.

One regular expression cuts a text into gaps and matches.  A match whose number
or date is valid (check digits, octets, number plan, calendar) is replaced by a
keyed permutation within its own format; equal values so get equal pseudonyms in
every document, and an invalid look-alike stays as it is.  The permutation is a
Feistel network whose round function is SHA-256 under the key:

* numbers and dates are written as a pair (left, right) in Z_a x Z_b and the
  halves are shifted in turn modulo a and b: cards without their check digit,
  which is then set anew; telephone numbers of ten digits, with or without country code 1;
  social security numbers; IPv4 addresses; dates by their day in a 400-year cycle;
* mail addresses, account numbers (IBAN) and credentials are split into two
  halves of characters, and each character moves within its own class (digit,
  lower case, upper case); IBAN check digits are set anew.

Defined cases: a null text stays null with zero counts, an empty one stays
empty; rows with null or repeated ids are treated one by one; other columns are
kept, and result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
CYCLE_START = "1800-01-01"  # dates of the 400 years from here; 146097 days = 27 * 5411
CYCLE = (27, 5411)

# What each kind looks like.  The order decides between kinds.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*\"?[A-Za-z0-9]{8,})|\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9])",
}
KINDS = list(PATTERNS)


def _combined() -> str:
    groups = 0
    parts = []
    for pattern in PATTERNS.values():
        own = pattern.count("([ -])")
        for k in range(own, 0, -1):
            pattern = pattern.replace(f"\\{k}", f"\\{groups + k}")
        groups += own
        parts.append(pattern)
    return "|".join(parts)


ANY = _combined()
# Every kind holds one of these; texts without them are not searched.
HINT = r"[0-9]{3}|@|\.[0-9]|(?i:password|passwd|secret|token|api)|[0-9]\.|AKIA[A-Z0-9]{16}|[A-Z]{2}[0-9]{2}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _prf(key: Column, kind: str, turn: Column, half: Column) -> Column:
    """60 bits of SHA-256 under the key."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel_pair(key: Column, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Permute (left, right) in Z_a x Z_b; the result is a struct of both."""
    def turn(state, k):
        return F.when(
            k % 2 == 0,
            F.struct(F.pmod(state["l"] + _prf(key, kind, k, state["r"]), a).alias("l"), state["r"].alias("r")),
        ).otherwise(F.struct(state["l"].alias("l"), F.pmod(state["r"] + _prf(key, kind, k, state["l"]), b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shift(ch: Column, by: Column) -> Column:
    code = F.ascii(ch)

    def within(first: str, size: int) -> Column:
        start = ord(first)
        return F.chr((F.lit(start) + F.pmod(code - start + by, F.lit(size))).cast("long"))

    return (F.when((code >= 48) & (code <= 57), within("0", 10))
            .when((code >= 97) & (code <= 122), within("a", 26))
            .when((code >= 65) & (code <= 90), within("A", 26)).otherwise(ch))


def _shifted(key: Column, kind: str, turn: Column, changed: Column, other: Column) -> Column:
    """``changed`` with each character moved in its class by amounts drawn from ``other``."""
    shape = F.translate(F.regexp_replace(F.regexp_replace(changed, "[a-z]", "a"), "[A-Z]", "A"), "0123456789", "0" * 10)
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), shape, other), 512)
    return _let(digest, lambda d: F.array_join(F.transform(
        F.split(changed, ""), lambda ch, i: _shift(ch, F.conv(F.substr(d, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int"))), ""))


def feistel_text(key: Column, kind: str, text: Column) -> Column:
    """Permute the characters of a text within their classes."""
    half = F.floor(F.length(text) / 2).cast("int")

    def turn(state, k):
        return F.when(k % 2 == 0, F.struct(_shifted(key, kind, k, state["l"], state["r"]).alias("l"), state["r"].alias("r"))
                      ).otherwise(F.struct(state["l"].alias("l"), _shifted(key, kind, k, state["r"], state["l"]).alias("r")))

    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    both = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.when(F.length(text) < 2, _shifted(key, kind, F.lit(0), text, F.lit(""))).otherwise(
        _let(both, lambda s: F.concat(s["l"], s["r"])))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    def step(state, ch):
        digit = ch.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substr(digits, state["at"], F.lit(1))).otherwise(ch)).alias("out"),
            (state["at"] + digit.cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled`` is the parity (from the right, 0 first) of the digits to double."""
    def step(total, ch, i):
        d = ch.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda ch, i: F.struct(ch.alias("c"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), lambda t, p: step(t, p["c"], p["i"]))


def _card(key: Column, match: Column) -> Column:
    def changed(digits):
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        half = F.floor(F.length(body) / 2).cast("int")
        rest = F.length(body) - half
        sizes = [F.pow(F.lit(10), n).cast("long") for n in (half, rest)]
        pair = feistel_pair(key, "card", F.substr(body, F.lit(1), half).cast("long"), F.substr(body, half + 1).cast("long"), *sizes)
        new = _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))
        return _let(new, lambda n: F.concat(n, F.pmod(F.lit(10) - _luhn(n, 0) % 10, F.lit(10)).cast("string")))

    return _let(_digits(match), lambda d: F.when(_luhn(d, 1) % 10 == 0, _refill(match, changed(d))).otherwise(match))


def _phone(key: Column, match: Column) -> Column:
    def changed(ten):
        pair = feistel_pair(key, "phone", F.substr(ten, F.lit(1), F.lit(3)).cast("long"), F.substr(ten, F.lit(4)).cast("long"),
                            F.lit(1_000), F.lit(10_000_000))
        new = _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), 3, "0"), F.lpad(p["r"].cast("string"), 7, "0")))
        country = F.substr(_digits(match), F.lit(1), F.length(_digits(match)) - 10)
        return _refill(match, F.concat(country, new))

    return _let(F.right(_digits(match), F.lit(10)), changed)


def _ssn(key: Column, match: Column) -> Column:
    def changed(nine):
        area, group, serial = (F.substr(nine, F.lit(s), F.lit(n)).cast("long") for s, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))  # 898 areas
        pair = feistel_pair(key, "ssn", index, (group - 1) * 9_999 + serial - 1, F.lit(898), F.lit(99 * 9_999))

        def text(p):
            new = p["l"] + F.when(p["l"] >= 665, F.lit(2)).otherwise(F.lit(1))
            return F.concat(F.lpad(new.cast("string"), 3, "0"),
                            F.lpad((F.floor(p["r"] / 9_999) + 1).cast("string"), 2, "0"),
                            F.lpad((p["r"] % 9_999 + 1).cast("string"), 4, "0"))

        return F.when(valid, _refill(match, _let(pair, text))).otherwise(match)

    return _let(_digits(match), changed)


def _ip(key: Column, match: Column) -> Column:
    def changed(octets):
        o = [octets[i].cast("long") for i in range(4)]
        valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
        pair = feistel_pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536))
        new = _let(pair, lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for h in ("l", "r") for x in (
            F.floor(p[h] / 256), p[h] % 256)]))
        return F.when(valid, new).otherwise(match)

    return _let(F.split(match, r"\."), changed)


def _date(key: Column, match: Column) -> Column:
    iso = match.rlike("^[0-9]{4}-")
    third = F.when(match.contains("/"), F.lit("/")).otherwise(F.lit("."))
    written = F.when(iso, match).otherwise(F.concat_ws("-", F.substr(match, F.lit(7), F.lit(4)), F.substr(match, F.lit(4), F.lit(2)),
                                                       F.substr(match, F.lit(1), F.lit(2))))

    def changed(day):
        index = F.datediff(day, F.lit(CYCLE_START).cast("date"))
        pair = feistel_pair(key, "date", F.floor(index / CYCLE[1]), index % CYCLE[1], F.lit(CYCLE[0]), F.lit(CYCLE[1]))
        new = _let(pair, lambda p: F.date_add(F.lit(CYCLE_START).cast("date"), (p["l"] * CYCLE[1] + p["r"]).cast("int")))
        text = _let(new, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(
            F.concat(F.date_format(d, "dd"), third, F.date_format(d, "MM"), third, F.date_format(d, "yyyy"))))
        return F.when((index >= 0) & (index < CYCLE[0] * CYCLE[1]), text).otherwise(match)

    return F.coalesce(_let(written.try_cast("date"), changed), match)


def _remainder_97(text: Column) -> Column:
    def step(rest, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(key: Column, match: Column) -> Column:
    def changed(plain):
        country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
        valid = (_remainder_97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & F.length(plain).between(15, 34)
        new = feistel_text(key, "iban", body)
        checked = _let(new, lambda n: F.concat(
            country, F.lpad((98 - _remainder_97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        spaced = F.when(match.contains(" "), F.trim(F.regexp_replace(checked, "(.{4})", "$1 "))).otherwise(checked)
        return F.when(valid, spaced).otherwise(match)

    return _let(F.replace(match, F.lit(" ")), changed)


def _mail(key: Column, match: Column) -> Column:
    at = F.instr(match, "@")
    return F.concat(feistel_text(key, "mail", F.substr(match, F.lit(1), at - 1)), F.substr(match, at))


def _secret(key: Column, match: Column) -> Column:
    head = F.regexp_extract(match, r"^(?i:AKIA|[a-z_-]+\s*[=:]\s*\"?)", 0)
    return F.concat(head, feistel_text(key, "secret", F.substr(match, F.length(head) + 1)))


MAKERS = {"mail": _mail, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(key: Column, match: Column) -> Column:
    """Struct of the pseudonym of one match and its kind (null where it isn't valid)."""
    chosen = None

    def labelled(kind):
        return lambda v: F.struct(v.alias("value"), F.when(v != match, F.lit(kind)).alias("kind"))

    for kind, make in MAKERS.items():
        new = _let(make(key, match), labelled(kind))
        test = match.rlike("^(?:" + PATTERNS[kind] + ")$")
        chosen = F.when(test, new) if chosen is None else chosen.when(test, new)
    return chosen.otherwise(F.struct(match.alias("value"), F.lit(None).cast("string").alias("kind")))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", count_column: str = "pii_found") -> DataFrame:
    """Replace personal data in the text; ``count_column`` holds the number of replacements of each kind."""
    text, secret = F.col(text_column), F.lit(key)
    searched = text.rlike(HINT)
    found = F.when(searched, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn("__new", F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(secret, m))))
    rebuilt = F.array_join(F.zip_with(
        F.split(text, ANY, -1), F.col("__new"), lambda gap, new: F.concat(gap, F.coalesce(new["value"], F.lit("")))), "")
    kinds = F.transform(F.col("__new"), lambda n: n["kind"])

    def is_kind(kind):
        return lambda k: k == kind

    counts = [F.coalesce(F.size(F.filter(kinds, is_kind(kind))), F.lit(0)).alias(kind) for kind in KINDS]
    return marked.withColumns({
        text_column: F.when(F.col("__new").isNull(), text).otherwise(rebuilt),
        count_column: F.struct(*counts)}).drop("__new")
