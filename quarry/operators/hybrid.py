"""Composite searches: hybrid with expansion and reranking, pseudo-relevance feedback,
the search of the command line and ``research``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.models import QUERY_PREFIX, Engine, NoModelError
from quarry.operators import search
from quarry.operators.query import QuerySyntaxError
from quarry.operators.search import Source
from quarry.schemas import LIMIT, LIST_DEPTH, RERANKED


def keyword(docs: Source, query: str, collection: str | None, limit: int, stemmed: bool = False) -> DataFrame:
    if collection:
        return search.bm25(docs, query, collection, limit, stemmed=stemmed)
    return search.bm25_normalized(docs, query, limit, stemmed=stemmed)


def weighted_fusion(lists: list[tuple[DataFrame, float]], limit: int = RERANKED) -> DataFrame:
    """Fusion with weights and bonuses; lists count in the order given."""
    parts = [search.as_list(df, f"{i:03d}", weight) for i, (df, weight) in enumerate(lists)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return search.fuse(out, limit, bonus=True)


def blend(fused: DataFrame, scores: DataFrame | None, limit: int) -> DataFrame:
    """Mix the fused score with rerank scores (docid, rerank): three quarters of it for
    the first three places, 0.6 up to the tenth, 0.4 below. Without scores the order
    stays."""
    if scores is None:
        return fused.where(F.col("rank") < limit)
    share = F.when(F.col("rank") < 3, 0.75).when(F.col("rank") < 10, 0.60).otherwise(0.40)
    rest = F.when(F.col("rank") < 3, 0.25).when(F.col("rank") < 10, 0.40).otherwise(0.60)
    mixed = fused.join(F.broadcast(scores), "docid").withColumn("score", F.col("score") * share + F.col("rerank") * rest)
    order = Window.orderBy(F.desc(F.round("score", 12)), "docid")
    mixed = mixed.withColumn("rank", F.row_number().over(order) - 1)
    return mixed.where(F.col("rank") < limit).select("rank", *search.RESULT, "score")


def hybrid(docs: Source, chunks: DataFrame, engine: Engine, query: str, collection: str | None = None, limit: int = LIMIT, stemmed: bool = False) -> DataFrame:
    """Lists of 20 for the query (weight 2) and its expansions (weight 1), fused, the
    best 30 reranked and blended. A list that fails is left out."""
    asked = [(query, 2.0, ("lex", "vec"))] + [(q, 1.0, (kind,)) for q, kind in engine.expand(query)]
    lists: list[tuple[DataFrame, float]] = []
    for q, weight, kinds in asked:
        for kind in kinds:
            try:
                if kind == "lex":
                    lists.append((keyword(docs, q, collection, LIST_DEPTH, stemmed), weight))
                else:
                    vector = engine.embed(QUERY_PREFIX + q, True)
                    lists.append((search.vector_search(docs, chunks, vector, collection, LIST_DEPTH), weight))
            except (QuerySyntaxError, NoModelError):
                continue
    if not lists:
        return search.table(docs).where("false").select(F.lit(0).alias("rank"), *search.RESULT, F.lit(0.0).alias("score"))
    fused = weighted_fusion(lists)
    rows = fused.orderBy("rank").collect()
    if not rows:
        return fused
    given = engine.rerank(query, [f"{r['title']} " for r in rows])
    spark = search.table(docs).sparkSession
    scores = spark.createDataFrame([(r["docid"], float(s)) for r, s in zip(rows, given)], "docid string, rerank double")
    kept = spark.createDataFrame(rows, fused.schema)
    return blend(kept, scores, limit)


def feedback(docs: Source, chunks: DataFrame, query: str, collection: str | None = None, limit: int = LIMIT, stemmed: bool = False) -> DataFrame:
    """Pseudo-relevance feedback without models: the mean vector of the best 20 keyword
    results searches all vectors; both are fused. Where a step finds nothing, the keyword
    results stand."""
    first = keyword(docs, query, collection, LIST_DEPTH, stemmed)
    docids = [r["docid"] for r in first.orderBy("rank").collect()]
    vector = search.centroid(docs, chunks, docids) if docids else []
    near = search.vector_search(docs, chunks, vector, None, limit) if vector else None
    if near is None or near.isEmpty():
        return first.where(F.col("rank") < limit)
    return search.simple_fusion(first, near, limit)


def smart(docs: Source, chunks: DataFrame, engine: Engine, query: str, collection: str | None = None, limit: int = LIMIT, stemmed: bool = False) -> DataFrame:
    """Hybrid with all models; plain BM25 fused with vectors with an embedder; else BM25."""
    if engine.has_embedder and engine.has_expander and engine.has_reranker:
        return hybrid(docs, chunks, engine, query, collection, limit, stemmed)
    if not engine.has_embedder:
        return search.bm25(docs, query, collection, limit, stemmed=stemmed)
    words = search.bm25(docs, query, collection, 2 * limit, stemmed=stemmed)
    try:
        vector = engine.embed(QUERY_PREFIX + query, True)
    except NoModelError:
        return words.where(F.col("rank") < limit)
    return search.simple_fusion(words, search.vector_search(docs, chunks, vector, collection, 2 * limit), limit)


def research(docs: Source, chunks: DataFrame, query: str, vector=None, collection: str | None = None, limit: int = LIMIT, min_score: float = 0.0, stemmed: bool = False) -> DataFrame:
    """Keyword (normalised without a collection) and vector results of twice the depth,
    fused; scores below ``min_score`` go. Either side may be missing."""
    empty = search.table(docs).where("false").select(F.lit(0).alias("rank"), *search.RESULT, F.lit(0.0).alias("score"))
    try:
        words = keyword(docs, query, collection, 2 * limit, stemmed)
    except QuerySyntaxError:
        words = empty
    near = search.vector_search(docs, chunks, vector, collection, 2 * limit) if vector else empty
    out = search.simple_fusion(words, near, limit)
    return out.where(F.col("score") >= min_score) if min_score > 0 else out
