"""Personal data by proposal, validation and context.

Regular expressions propose spans, validators confirm them (octets up to 255, Luhn,
digit counts, the mod-97 rule), and words shortly before a span raise or lower its score.
Spans of the base kinds stay whatever their score; those of the added kinds need
``KEEP``. Everything is DataFrame expressions: a text is split at its matches, and
the lengths of the pieces give the places in code points. A kind's expressions run only
on texts that hold the characters it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
KEEP = 0.5


class Kind(NamedTuple):
    """``needs``: substrings without which no match is possible. ``valid``: from the
    match to a boolean. ``prior``: score of a valid span; ``near``: words that add 0.4
    when found within ``CONTEXT`` characters before it; ``against``: that take off 0.4."""

    name: str
    pattern: str
    needs: tuple[str, ...]
    valid: Callable[[Column], Column]
    base: bool
    prior: float
    near: tuple[str, ...]
    against: tuple[str, ...] = ()


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """The checksum of card numbers over the digits of ``match``."""
    numbers = F.reverse(F.split(digits(match), ""))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod_97(match: Column) -> Column:
    """The checksum of account numbers: first four characters last, letters as 10 to 35,
    remainder 1."""
    plain = F.upper(F.regexp_replace(match, " ", ""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) < 65, 48).otherwise(55)
    return F.aggregate(F.split(F.regexp_replace(moved, "[^0-9A-Z]", ""), ""), F.lit(0), lambda a, c: (a * F.when(F.ascii(c) < 65, 10).otherwise(100) + value(c)) % 97) == 1


def _octets(match: Column) -> Column:
    return F.forall(F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0"))), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(low, high)


def _card(match: Column) -> Column:
    return F.when(_digit_count(12, 19)(match), luhn(match)).otherwise(F.lit(False))


def _always(match: Column) -> Column:
    return F.lit(True)


#: In the order in which spans of one start are listed. Repetitions are possessive where
#: that changes no match, which keeps matching linear on any text.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), _always, True, 0.9, ("mail", "contact")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", (".", "[0-9]"), _octets, True, 0.8, ("ip", "host", "server"), ("version",)),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", ("[0-9]",), _card, True, 0.8, ("card", "visa", "credit")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+", "[0-9]"), _digit_count(9, 15), True, 0.8, ("phone", "tel", "call", "mobile")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ("[A-Z]", "[0-9]"), mod_97, False, 0.9, ("iban", "account", "bank", "konto")),
    Kind("ssn", r"(?<![0-9A-Za-z.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", ("-", "[0-9]"), _always, False, 0.3, ("ssn", "social security", "social")),
    Kind("phone_local", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", ("[0-9]",), _digit_count(10, 10), False, 0.2, ("phone", "tel", "call", "mobile", "fax"), ("order", "invoice")),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements that are folded one by one; longer arrays are folded block by block.
_BLOCK = 64


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers ``values`` the fold of 0, it and those before it. Arrays
    of n elements take about 32 n + n * n / 8192 steps, and no array is grown in steps."""
    fold = lambda array: F.aggregate(array, F.lit(0), merge)

    def blocks(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / _BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(own, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(own) > 0, _let(cut, joined)).otherwise(F.expr("cast(array() as array<int>)"))

    def joined(cut: Column) -> Column:
        def within(totals: Column) -> Column:
            def block(x: Column, b: Column) -> Column:
                return _let(fold(F.slice(totals, F.lit(1), b)), lambda base: F.transform(x, lambda _, i: merge(base, fold(F.slice(x, F.lit(1), i + 1)))))

            return F.flatten(F.transform(cut, block))

        return _let(F.transform(cut, fold), within)

    return _let(values, blocks)


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, kind, score>> of the confirmed spans of one kind."""
    pieces = F.split(text, kind.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string, score: double>>)")

    def span(item: Column, end: Column) -> Column:
        before = F.lower(F.right(item["before"], F.lit(CONTEXT)))
        has = lambda found: F.when(before.rlike(r"(?<![a-z])(?:" + "|".join(found) + ")"), 0.4).otherwise(0.0) if found else F.lit(0.0)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.prior) + has(kind.near) - has(kind.against)))
        keep = kind.valid(item["match"]) & (F.lit(kind.base) | (score >= KEEP))
        start = end - F.length(item["match"])
        return F.when(keep, F.struct(start.alias("start"), end.alias("end"), F.lit(kind.name).alias("kind"), F.round(score, 2).alias("score")))

    def placed(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda p: F.length(p["before"]) + F.length(p["match"])), lambda a, x: a + x)
        return F.filter(F.zip_with(pairs, ends, span), lambda s: s.isNotNull())

    pairs = _let(pieces, lambda own: F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), matches, lambda p, m: F.struct(p.alias("before"), m.alias("match"))))
    possible = F.lit(True)
    for need in kind.needs:
        possible = possible & (text.rlike(need) if need.startswith("[") else F.contains(text, F.lit(need)))
    return F.when(possible, _let(pairs, placed)).otherwise(none)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, column: str = "pii") -> DataFrame:
    """The columns of ``docs`` and ``column``: array<struct<start, end, kind, score>> by
    start, then in the order of ``kinds``, in code points with the end exclusive.

    Null and empty texts have no spans. An existing column of that name is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn(column, F.concat(*(spans_of(text, k) for k in kinds)))
    rank = {k.name: i for i, k in enumerate(kinds)}
    ranks = F.create_map(*(F.lit(x) for k, i in rank.items() for x in (k, i)))
    keyed = F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.element_at(ranks, s["kind"]).alias("rank"), s.alias("span")))
    return found.withColumn(column, F.transform(F.array_sort(keyed), lambda s: s["span"]))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span that is found in the text replaced by ``<kind>``; spans that
    overlap become one, named after the first. Null texts stay null."""
    spans = "_pii_spans"
    found = find_pii(docs, kinds, spans)
    text = F.col("text")

    def clean(reach: Column) -> Column:
        """``reach``: how far each span and those before it go."""
        before = F.transform(reach, lambda _, i: F.coalesce(F.get(reach, i - 1), F.lit(0)))
        shown = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(F.substr(text, at + 1, s["start"] - at), F.lit("<"), s["kind"], F.lit(">"))))
        return F.concat(F.array_join(shown, ""), F.substr(text, F.element_at(reach, -1) + 1))

    clean = _let(_running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), clean)
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans)
