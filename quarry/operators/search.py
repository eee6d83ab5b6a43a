"""Ranked retrieval: BM25, collection-normalised BM25 and exact vector search.

Documents come as an :class:`Index`, from which keyword scores are read without a look at
any text, or as a DataFrame with id, collection, path, title, docid, hash, active, doc_len
and content, which is then tokenised. Results have rank (from 0), docid, path, title,
context and score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text, vectors
from quarry.operators import index
from quarry.operators.index import Index
from quarry.operators.query import FIELDS, Phrase, parse
from quarry.schemas import B, FALLBACK_LENGTH, FIELD_WEIGHTS, K1, LIMIT, RRF_K, TARGET_B

RESULT = ("docid", "path", "title", "context")
Source = DataFrame | Index


def table(source: Source) -> DataFrame:
    """The documents of a source as rows."""
    return source.documents if isinstance(source, Index) else source


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def of(row):
        if row is None:
            return None
        for t in row:
            if t not in known:
                known[t] = text.stem(t)
        return [known[t] for t in row]

    return tokens.map(of)


def with_tokens(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """Adds the columns ``t_title``, ``t_content`` and ``t_docid``."""
    for field in FIELDS:
        tokens = text.tokens(F.coalesce(field, F.lit("")))
        docs = docs.withColumn(f"t_{field}", _stems(tokens) if stemmed else tokens)
    return docs


def phrase_hits(tokens: Column, phrase: Phrase) -> Column:
    """How often the phrase begins at a token; occurrences may overlap."""
    *exact, last = phrase.terms or (None,)
    if last is None:
        return F.lit(0)

    def count(own: Column) -> Column:
        def here(token: Column, i: Column) -> Column:
            found = F.lit(True)
            for k, term in enumerate(exact):
                found = found & ((F.get(own, i + k) if k else token) == term)
            end = F.get(own, i + len(exact)) if exact else token
            found = found & (end.startswith(last) if phrase.prefix else end == last)
            return F.coalesce(found & (i == 0) if phrase.first else found, F.lit(False))

        return F.size(F.filter(own, here))

    return _bound(tokens, count)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _term(rows: float, n: Column, f: Column, tokens: Column, average: float) -> Column:
    """What a phrase that ``n`` of ``rows`` documents hold adds to a score."""
    idf = F.ln((F.lit(float(rows)) - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * tokens / F.lit(average)))


def _scored(docs: Source, phrases: Sequence[Phrase], stemmed: bool) -> tuple[DataFrame, float]:
    """Active rows that hold every phrase, with their raw score, and the mean length.

    Statistics cover all rows, inactive ones included and whatever the collection: rows
    N, rows n with the phrase in an allowed field, mean tokens of a row. The mean length
    of the later correction covers active documents that have one.
    """
    if isinstance(docs, Index):
        found, counts = index.weighted(docs, phrases, stemmed)
        score = sum((_term(docs.rows, n, F.col(f"f{i}"), F.col("tokens"), docs.tokens) for i, n in enumerate(counts)), F.lit(0.0))
        return found.withColumn("score", score), docs.length
    docs = with_tokens(docs, stemmed)

    def counts(row: Column) -> Column:
        """Tokens and, for each phrase, hits and weighted hits, from tokens bound once."""
        out = [sum((F.size(row[f]) for f in FIELDS), F.lit(0)).alias("tokens")]
        for i, phrase in enumerate(phrases):
            fields = [f for f in FIELDS if phrase.field in (None, f)]
            weighted = lambda h, fields=tuple(fields): F.struct(
                sum((h[k] for k in range(len(fields))), F.lit(0)).alias("any"), sum((FIELD_WEIGHTS[f] * h[k] for k, f in enumerate(fields)), F.lit(0.0)).alias("f")
            )
            hits = F.array(*(phrase_hits(row[f], phrase) for f in fields))
            out.append(_bound(hits, weighted).alias(f"p{i}"))
        return F.struct(*out)

    docs = docs.withColumn("hit", _bound(F.struct(*(F.col(f"t_{f}").alias(f) for f in FIELDS)), counts))
    docs = docs.drop(*(f"t_{f}" for f in FIELDS), "content")
    for i in range(len(phrases)):
        docs = docs.withColumn(f"any{i}", F.col(f"hit.p{i}.any")).withColumn(f"f{i}", F.col(f"hit.p{i}.f"))
    docs = docs.withColumn("tokens", F.col("hit.tokens")).drop("hit")
    stats = docs.agg(
        F.count("*").alias("rows"),
        F.avg("tokens").alias("tokens"),
        F.avg(F.when(F.col("active") & (F.col("doc_len") > 0), F.col("doc_len"))).alias("length"),
        *(F.count_if(F.col(f"any{i}") > 0).alias(f"n{i}") for i in range(len(phrases))),
    ).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + _term(stats["rows"], F.lit(float(stats[f"n{i}"])), F.col(f"f{i}"), F.col("tokens"), stats["tokens"] or 1.0)
    matched = docs.where(" and ".join(f"any{i} > 0" for i in range(len(phrases)))).where("active")
    return matched.withColumn("score", score), stats["length"] or FALLBACK_LENGTH


def _shown(docs: Source, found: DataFrame, limit: int, per: str | None = None) -> DataFrame:
    """The ``limit`` best rows of ``found`` (of each ``per``), with title and context."""
    if not isinstance(docs, Index):
        return found
    order = Window.partitionBy(*([per] if per else [])).orderBy(F.desc("score"), "docid", "path")
    near = found.withColumn("near", F.row_number().over(order)).where(F.col("near") <= limit).drop("near")
    # A limited number of rows: the documents, with their titles, stay where they are.
    return docs.documents.select("id", "title", "context").join(F.broadcast(near), "id")


def length_factor(doc_len: Column, average: float, intended: bool = False) -> Column:
    """Changes the weight of length in a score from ``B`` towards ``TARGET_B``. As given
    it lowers long documents further; ``intended`` is the inverse ratio."""
    ratio = doc_len / F.lit(float(average))
    new, old = 1 - TARGET_B + TARGET_B * ratio, 1 - B + B * ratio
    factor = old / new if intended else new / old
    return F.when(doc_len > 0, factor).otherwise(1.0)


def bm25(docs: Source, query: str | Sequence[Phrase], collection: str | None = None, limit: int = LIMIT, corrected: bool = True, intended: bool = False, stemmed: bool = False) -> DataFrame:
    """The ``limit`` active documents with the best raw score, in order of the score
    after length correction. Ties go by docid and path."""
    phrases = parse(query, stemmed) if isinstance(query, str) else query
    found, average = _scored(docs, phrases, stemmed)
    if collection:
        found = found.where(F.col("collection") == collection)
    top = _shown(docs, found, limit).orderBy(F.desc("score"), "docid", "path").limit(limit)
    if corrected:
        top = top.withColumn("score", F.col("score") * length_factor(F.col("doc_len"), average, intended))
    order = Window.orderBy(F.desc("score"), "docid", "path")
    return top.select((F.row_number().over(order) - 1).alias("rank"), *RESULT, "score")


def with_snippets(result: DataFrame, docs: DataFrame, query: str | Sequence[Phrase], width: int = 160) -> DataFrame:
    """``result`` with ``snippet``: ``width`` characters of the content around the first
    word of the query, or its beginning where only title or docid fit."""
    phrases = parse(query) if isinstance(query, str) else query
    words = sorted({t for p in phrases for t in p.terms}, key=lambda t: (-len(t), t))
    pattern = "(?<![\\p{L}\\p{N}])(?:" + "|".join(map(re.escape, words)) + ")" if words else "(?!)"
    own = docs.select("docid", "path", F.coalesce("content", F.lit("")).alias("content"))
    at = F.greatest(F.regexp_instr(F.lower("content"), F.lit(pattern)) - width // 4, F.lit(1))
    near = own.join(F.broadcast(result.select("docid", "path")), ["docid", "path"], "left_semi")  # the result's rows, a limited number
    shown = near.select("docid", "path", F.regexp_replace(F.substr("content", at, F.lit(width)), r"\s+", " ").alias("snippet")).dropDuplicates(["docid", "path"])
    return result.join(shown, ["docid", "path"], "left").select(*result.columns, "snippet")


def active_collections(docs: Source) -> DataFrame:
    return table(docs).where("active").select("collection").distinct()


def bm25_normalized(docs: Source, query: str | Sequence[Phrase], limit: int = LIMIT, stemmed: bool = False) -> DataFrame:
    """BM25 in each collection, fused by reciprocal rank so that small collections count.
    With at most one active collection it is plain BM25. All collections are ranked in
    one pass; equal contents share a docid and add up."""
    if active_collections(docs).limit(2).count() <= 1:
        return bm25(docs, query, None, limit, stemmed=stemmed)
    phrases = parse(query, stemmed) if isinstance(query, str) else query
    found, average = _scored(docs, phrases, stemmed)
    own = Window.partitionBy("collection").orderBy(F.desc("score"), "docid", "path")
    top = _shown(docs, found, limit, "collection").withColumn("raw", F.row_number().over(own)).where(F.col("raw") <= limit)
    top = top.withColumn("score", F.col("score") * length_factor(F.col("doc_len"), average))
    lists = top.withColumn("rank", F.row_number().over(own) - 1)
    return fuse(lists.select(F.col("collection").alias("list"), F.lit(1.0).alias("weight"), "rank", *RESULT), limit)


def fuse(lists: DataFrame, limit: int, bonus: bool = False) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (list, weight, rank and the result's
    columns): ``weight / (60 + rank + 1)`` summed over a docid; with ``bonus`` 0.05 more
    for a list's first place and 0.02 for its second and third. A docid is shown as in
    the first list that has it."""
    term = F.col("weight") / (RRF_K + F.col("rank") + 1)
    if bonus:
        term = term + F.when(F.col("rank") == 0, 0.05).when(F.col("rank") <= 2, 0.02).otherwise(0.0)
    shown = F.min_by(F.struct(*(c for c in RESULT if c != "docid")), F.struct("list", "rank", "path"))
    fused = lists.groupBy("docid").agg(F.sum(term).alias("score"), shown.alias("shown"))
    top = fused.orderBy(F.desc(F.round("score", 12)), "docid").limit(limit)
    order = Window.orderBy(F.desc(F.round("score", 12)), "docid")
    return top.select((F.row_number().over(order) - 1).alias("rank"), "docid", *(F.col(f"shown.{c}").alias(c) for c in RESULT if c != "docid"), "score")


def as_list(result: DataFrame, name: str, weight: float = 1.0) -> DataFrame:
    return result.select(F.lit(name).alias("list"), F.lit(float(weight)).alias("weight"), "rank", *RESULT)


def simple_fusion(keyword: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """Unweighted fusion of two results; a docid of both is shown as in the last keyword
    row that has it."""
    keyword = as_list(keyword, "a")
    last = keyword.withColumn("again", F.row_number().over(Window.partitionBy("docid").orderBy(F.desc("rank"))))
    shown = last.where("again = 1").select("docid", F.struct(*(c for c in RESULT if c != "docid")).alias("own"))
    fused = fuse(keyword.unionByName(as_list(vector, "b")), limit)
    both = fused.join(F.broadcast(shown), "docid", "left")
    columns = [F.coalesce(f"own.{c}", c).alias(c) for c in RESULT if c != "docid"]
    return both.select("rank", "docid", *columns, "score")


def similar_chunks(chunks: DataFrame, query: Sequence[float]) -> DataFrame:
    """hash and sim (the best cosine of its chunks) where it is above 0. Vectors of
    another dimension or without length are passed over."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    if not length:
        return chunks.where("false").select("hash", F.lit(0.0).alias("sim"))
    own = chunks.where(F.col("vec").isNotNull() & (F.size("vec") == len(query)))
    own = own.select("hash", vectors.dot(F.col("vec"), vectors.literal(query)).alias("dot"), vectors.norm(F.col("vec")).alias("norm")).where("norm > 0")
    return own.groupBy("hash").agg(F.max(F.col("dot") / (F.col("norm") * length)).alias("sim")).where("sim > 0")


def one_document(docs: DataFrame, *keep: str) -> DataFrame:
    """One active document for each hash, that with the first path. Columns to ``keep``
    are the same for all documents of a hash."""
    shown = F.min_by(F.struct("docid", "path", "title", "context"), F.struct("path", "id"))
    return docs.where("active").groupBy("hash", *keep).agg(shown.alias("doc")).select("hash", *keep, "doc.*")


def vector_search(docs: Source, chunks: DataFrame, query: Sequence[float], collection: str | None = None, limit: int = LIMIT, min_score: float = 0.0) -> DataFrame:
    """The ``limit`` most similar contents, each with one of its documents. A content
    takes its place before documents are looked up, so fewer rows may come back; the
    lookup is not restricted to the collection. ``min_score`` applies last."""
    docs = table(docs)
    if collection:
        chunks = chunks.join(docs.where(F.col("active") & (F.col("collection") == collection)).select("hash").distinct(), "hash", "left_semi")
    top = similar_chunks(chunks, query).orderBy(F.desc("sim"), "hash").limit(limit)
    # Joined first, so that the titles of other documents are not moved.
    found = one_document(docs.join(F.broadcast(top), "hash"), "sim")
    if min_score > 0:
        found = found.where(F.col("sim") >= min_score)
    order = Window.orderBy(F.desc("sim"), "hash")
    return found.select((F.row_number().over(order) - 1).alias("rank"), *RESULT, F.col("sim").alias("score"))


def centroid(docs: Source, chunks: DataFrame, docids: Sequence[str]) -> list[float]:
    """The normalised mean of the vectors of these documents; empty without any."""
    hashes = table(docs).where(F.col("active") & F.col("docid").isin(list(docids))).select("hash").distinct()
    own = chunks.join(F.broadcast(hashes), "hash", "left_semi").where(F.col("vec").isNotNull() & (F.size("vec") > 1))
    sums = own.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    values = [r["x"] for r in sums.orderBy("i").collect()]
    length = sum(x * x for x in values) ** 0.5
    return [x / length for x in values] if length else values
