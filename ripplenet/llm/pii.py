"""Format-preserving pseudonyms for personal data.

A span is replaced only if it validates (calendar date, octets up to 255, Luhn digit and so on). Its value is permuted
by a keyed Feistel network inside its own format, so the result is valid too, equal values get equal pseudonyms in every
document, and the key holder can undo it. No table of values exists anywhere; each row is handled on its own.

Round functions are SHA-512 of key, kind, round and the other half. Characters stay within their class (digit, lower or
upper case letter). Dates use 27 x 5411 halves, the days of the 400 years from 1800; social security numbers use exactly
the valid areas, groups and serials; addresses two 16-bit halves; card numbers get their check digit anew.

Nulls and edge cases: a null text stays null, an empty one empty. Spans that do not validate stay as they are. Rows are
handled one by one; a null ``doc_id`` and repeated rows pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import let, positions

ROUNDS = 8
# Fixed patterns, in the order in which they are tried at a position.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
_BASE_DAY = "1800-01-01"
_DAYS_A, _DAYS_B = 27, 5411


def _digest(key: str, kind: str, n: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n, half), 512)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, back: bool = False) -> Column:
    """Permutation of the pairs ``0 <= a < size_a``, ``0 <= b < size_b``: the halves shift each other in turn."""
    sign = -1 if back else 1

    def shift(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        f = _number(F.substring(_digest(key, kind, n, F.when(even, s["b"]).otherwise(s["a"])), 1, 15)) * sign
        return F.struct(
            F.when(even, F.pmod(s["a"] + f, F.lit(size_a))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + f, F.lit(size_b))).alias("b"),
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in _rounds(back)]), start, shift)


def _rounds(back: bool) -> list[int]:
    return list(reversed(range(ROUNDS))) if back else list(range(ROUNDS))


def feistel_text(text: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permutation of the texts with the same classes of characters; the halves of up to 64 characters shift each other."""
    sign = -1 if back else 1

    def turn(c: Column, k: Column) -> Column:
        within = lambda low, n: F.chr(F.pmod(F.ascii(c) - low + sign * k, F.lit(n)) + low)
        return (
            F.when(c.rlike("^[0-9]$"), within(48, 10)).when(c.rlike("^[a-z]$"), within(97, 26))
            .when(c.rlike("^[A-Z]$"), within(65, 26)).otherwise(c)
        )

    def moved(chars: Column, other: Column, n: Column) -> Column:
        stream = lambda d: F.transform(
            chars, lambda c, i: turn(c, F.pmod(_number(F.substr(d, i * 4 + 1, F.lit(4))), F.lit(260)))
        )
        return let(_digest(key, kind, n, F.array_join(other, "")), stream)

    def shift(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, moved(s["a"], s["b"], n)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], n)).alias("b"),
        )

    def run(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        start = F.struct(
            F.slice(chars, 1, half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b")
        )
        rounds = F.array(*[F.lit(i) for i in _rounds(back)])
        return F.aggregate(rounds, start, shift, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), run)


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""

    def filled(gaps: Column) -> Column:
        n = F.size(gaps) - 1
        body = F.transform(positions(n), lambda i: F.concat(F.get(gaps, i), F.substr(digits, i + 1, F.lit(1))))
        return F.concat(F.array_join(body, ""), F.get(gaps, n))

    return let(F.split(shape, "[0-9]", -1), filled)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that belongs behind ``payload``."""

    def added(x: Column, i: Column) -> Column:
        twice = x * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    numbers = F.transform(F.regexp_extract_all(F.reverse(payload), F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(numbers, added), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _email(m: Column, key: str, back: bool) -> Column:
    at = F.instr(m, "@")
    local, domain = F.substr(m, F.lit(1), at - 1), F.substr(m, at)
    return F.concat(feistel_text(local, key, "email", back), domain)


def _phone(m: Column, key: str, back: bool) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    country = F.when(country == "", F.substr(m, F.lit(1), F.lit(2))).otherwise(country)
    rest = F.substr(m, F.char_length(country) + 1)
    return F.concat(country, _fill(rest, feistel_text(_digits(rest), key, "phone", back)))


def _ipv4(m: Column, key: str, back: bool) -> Column:
    def of(o: Column) -> Column:
        octet = lambda i: F.get(o, F.lit(i)).cast("bigint")
        pair = feistel_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ipv4", back)
        split = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        new = let(pair, lambda p: F.concat_ws(".", *split(p["a"]), *split(p["b"])))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), new).otherwise(m)

    return let(F.split(m, r"\."), of)


def _ssn(m: Column, key: str, back: bool) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("bigint")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    row = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel_pair(row * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", back)

    def written(p: Column) -> Column:
        at = F.floor(p["a"] / 99)
        new_area = F.when(at >= 665, at + 2).otherwise(at + 1)
        parts = ((new_area, 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, let(pair, written)).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    dotted = m.contains(".")
    iso = F.when(dotted, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(m)

    def moved(day: Column) -> Column:
        n = F.datediff(day, F.lit(_BASE_DAY).cast("date"))
        pair = feistel_pair(F.floor(n / _DAYS_B), n % _DAYS_B, _DAYS_A, _DAYS_B, key, "date", back)
        new = F.date_add(F.lit(_BASE_DAY).cast("date"), let(pair, lambda p: (p["a"] * _DAYS_B + p["b"]).cast("int")))
        text = F.when(dotted, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd"))
        return F.when((n >= 0) & (n < _DAYS_A * _DAYS_B), text).otherwise(m)

    return F.coalesce(let(F.try_to_date(iso, "yyyy-MM-dd"), moved), m)


def _card(m: Column, key: str, back: bool) -> Column:
    def moved(d: Column) -> Column:
        n = F.char_length(d)
        payload = F.substr(d, F.lit(1), n - 1)
        new = let(feistel_text(payload, key, "card", back), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(luhn_digit(payload) == F.substr(d, n), _fill(m, new)).otherwise(m)

    return let(_digits(m), moved)


WRITERS: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email, "phone": _phone, "ipv4": _ipv4, "ssn": _ssn, "date": _date, "card": _card,
}


def pseudonyms(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``(doc_id, text, n_<kind> ...)``: each text with its valid spans permuted under ``key``; ``back`` undoes it.

    ``n_<kind>`` counts the spans of that kind that were replaced.
    """
    kinds = list(PATTERNS)
    text = F.col("text")

    def written(m: Column) -> Column:
        kind = F.lit(len(kinds) - 1)
        new = WRITERS[kinds[-1]](m, key, back)
        for i in reversed(range(len(kinds) - 1)):
            fits = m.rlike(f"^(?:{PATTERNS[kinds[i]]})$")
            kind = F.when(fits, F.lit(i)).otherwise(kind)
            new = F.when(fits, WRITERS[kinds[i]](m, key, back)).otherwise(new)
        return F.struct(m.alias("old"), new.alias("new"), kind.alias("kind"))

    found = F.when(
        text.rlike("[0-9@]"),
        F.struct(
            F.split(text, ANY, -1).alias("gaps"),
            F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), written).alias("hits"),
        ),
    )
    rows = docs.select("doc_id", "text", found.alias("_f"))
    gaps, hits = F.col("_f")["gaps"], F.col("_f")["hits"]
    body = F.transform(hits, lambda h, i: F.concat(F.get(gaps, i), h["new"]))
    whole = F.concat(F.array_join(body, ""), F.get(gaps, F.size(hits)))
    counted = lambda i: F.filter(hits, lambda h: (h["kind"] == i) & (h["new"] != h["old"]))
    return rows.select(
        "doc_id", F.when(F.size(hits) > 0, whole).otherwise(text).alias("text"),
        *[F.coalesce(F.size(counted(i)), F.lit(0)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(kinds)],
    )
