"""Document fingerprints by order MinHash, as DataFrame expressions.

A text is a sequence of tokens: its words, a word of more than ``LONG`` characters being
its characters, and each character of a script without spaces. The rule looks at the word
alone, whatever the text's size. A k-mer is a token and those before it, as far as there are
any, so each token ends one and a text of few tokens has k-mers too. K-mers are
numbered among equal ones, so a repetition counts. In
each of ``SLOTS`` slots (the number's hash decides) the ``TUPLE`` least are selected, put
back in the order of the text and hashed together. A signature is the filled slots'
hashes: two texts agree in a slot if they have the same least k-mers in the same order
there, which an edit disturbs near its place only, while moving a passage changes orders.

Every occurrence is numbered, by one sort of the text's k-mers. The selection tries the
numbered k-mers below a bound that about ``LEAST`` pass; hashes of numbered k-mers are
distinct, so nearly always every slot is full then. If one is not, all are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 3
SLOTS = 32
TUPLE = 2
LEAST = 512
LONG = 16


_SPACE = " \t\n\x0b\x0c\r"


#: Of a regular expression's class: characters that are tokens whatever is next to them.
#: Ranges (Thai, Lao, Burmese, Khmer, kana, Han), as a look-up of scripts is slow.
_ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_IN_WORD = rf"[^ \t-\r{_ALONE}]"
_TOKEN = rf"(?<!{_IN_WORD}){_IN_WORD}{{1,{LONG}}}+(?!{_IN_WORD})|[^ \t-\r]"


def _tokens(text: Column) -> Column:
    bare = F.trim(text, F.lit(_SPACE))
    words = F.split(bare, r"[ \t-\r]+")  # the same, faster, where all tokens are words
    tokens = F.when(F.rlike(bare, F.lit(rf"[{_ALONE}]|(?:^|[ \t-\r])[^ \t-\r]{{{LONG + 1}}}")), F.regexp_extract_all(bare, F.lit(_TOKEN), F.lit(0))).otherwise(words)
    return F.when(F.length(bare) > 0, tokens).otherwise(F.expr("cast(array() as array<string>)"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def signature(text: Column) -> Column:
    """array<bigint>: a hash for each filled slot of a text that is not null, in order of
    the slots; empty for a text without tokens."""
    return _let(_let(_let(_tokens(text), _kmers), _numbered), _slots)


def _kmers(t: Column) -> Column:
    """(hash, place) of all k-mers, in order of their hashes, then places. The place is
    that of the last token; nulls before the first one add nothing to a hash."""
    return F.sort_array(F.transform(t, lambda x, i: F.struct(F.xxhash64(*(F.get(t, i - k) for k in range(K - 1, 0, -1)), x).alias("h"), i.alias("at"))))


def _numbered(kmers: Column) -> Column:
    """(id, place) of the sorted ``kmers``; the id is a hash of the k-mer and its number
    among equal ones."""

    def named(first: Column, number: Column, place: Column) -> Column:
        return F.struct(F.xxhash64(F.get(kmers, first)["h"], number.cast("long")).alias("id"), F.get(kmers, place)["at"].alias("at"))

    def rest(r: Column) -> Column:
        return F.transform(F.sequence(r["first"] + 1, r["end"] - 1), lambda p: named(r["first"], p - r["first"] + 1, p))

    def number(firsts: Column) -> Column:
        runs = F.transform(firsts, lambda i, j: F.struct(i.alias("first"), F.coalesce(F.get(firsts, j + 1), F.size(kmers)).alias("end")))
        again = F.flatten(F.transform(F.filter(runs, lambda r: r["end"] - r["first"] > 1), rest))
        return F.concat(F.transform(firsts, lambda i: named(i, F.lit(1), i)), again)

    new = F.transform(kmers, lambda x, i: F.when((i == 0) | (F.get(kmers, i - 1)["h"] != x["h"]), i))
    return _let(F.filter(new, lambda i: i.isNotNull()), number)


def _slots(ids: Column) -> Column:
    n = F.size(ids)
    bound = F.when(n > LEAST, (F.lit(-(2.0**63)) + F.lit(2.0**64) * float(LEAST) / n).cast("long")).otherwise(F.lit(2**63 - 1))

    def select(some: Column) -> Column:
        """The ``TUPLE`` least of each slot."""
        ranked = F.sort_array(F.transform(some, lambda x: F.struct(F.pmod(x["id"], F.lit(SLOTS)).alias("slot"), x["id"], x["at"])))
        return _let(ranked, lambda r: F.filter(r, lambda x, i: (i < TUPLE) | (F.get(r, i - TUPLE)["slot"] != x["slot"])))

    def tuples(ordered: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            own = F.filter(F.slice(ordered, i + 1, F.lit(TUPLE)), lambda y: y["slot"] == x["slot"])
            first = (i == 0) | (F.get(ordered, i - 1)["slot"] != x["slot"])
            return F.when(first, F.xxhash64(x["slot"], F.transform(own, lambda y: y["id"])))

        return F.filter(F.transform(ordered, one), lambda h: h.isNotNull())

    low = _let(F.filter(ids, lambda x: x["id"] <= bound), select)
    chosen = _let(low, lambda c: F.when((F.size(c) == SLOTS * TUPLE) | (n <= LEAST), c).otherwise(select(ids)))
    return _let(F.sort_array(F.transform(chosen, lambda x: F.struct(x["slot"], x["at"], x["id"]))), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Slots that agree as a share of the slots filled in the fuller signature; 1 for two
    empty signatures, 0 for one."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(most, F.lit(1)))


def shown(signature_: Column) -> Column:
    """A signature as lower-case hex digits, 16 a slot."""
    return F.lower(F.array_join(F.transform(signature_, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``signature``. A null text counts as empty. An existing
    column of that name is replaced."""
    return docs.withColumn("signature", signature(F.coalesce("text", F.lit(""))))


def with_next(docs: DataFrame, columns: tuple[str, ...], parts: int | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``prepare(docs)`` and ``next_<column>`` of the row that follows in order of doc_id
    (then text); the first row follows the last. Null doc_ids come first.

    Rows are dealt to ranges of doc_id between approximate quantiles, which are few
    numbers whatever the table's size; a row that ends its range takes the first row of
    the next range that has one. ``prepare`` adds columns and runs once a row.
    """
    parts = parts or common.n_partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit([i / parts for i in range(1, parts)] or [0.5]), 10_000)).first()[0] or []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.expr("cast(array() as array<bigint>)")
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))))
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    follower = F.struct(*(F.col(c) for c in columns))
    rows = prepare(docs)
    near = rows.withColumn("next", F.lead(follower).over(order))
    least = docs.groupBy("range").agg(F.min("doc_id").alias("_least"))
    tied = docs.join(F.broadcast(least.withColumnRenamed("range", "_range")), (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_least")))
    ends = tied.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    ends = ends.withColumn("before", F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy())))
    ends = prepare(ends.select("before", "first.*")).select(F.col("before").alias("range"), follower.alias("wrap"))
    out = near.join(F.broadcast(ends), "range", "left").withColumn("next", F.coalesce("next", "wrap"))
    return out.select(*(c for c in rows.columns if c != "range"), *(F.col(f"next.{c}").alias(f"next_{c}") for c in columns))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (rounded down) replaced by as much of the start of
    ``following``, or all of it."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - n), F.substr(following, F.lit(1), n))
