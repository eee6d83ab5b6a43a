"""Registered search-engine queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text, vectors
from quarry.models import StubEngine
from quarry.operators import chunker, hybrid, lookup, search
from quarry.operators.index import stem
from quarry.operators.query import LINE_MARKS, expansions, parse
from quarry.plans import adapter, chunks
from quarry.plans.adapter import DOCS, SEVERAL, VECTORS
from quarry.plans.oracle import TOKENS, fused, nearest, normalized, result, scores, simple, statement, top
from quarry.plans.stems import STEMMED_TOKENS, stems

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

ONE, PAIR, PHRASE, TITLE, HEX, OTHER = "the", "th an", '"of the"', "title:th", "docid:a", "an"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def ranked(df: DataFrame) -> DataFrame:
    return df.select(F.col("rank").cast("long").alias("rank"), "docid", "path", "title", F.round("score", 6).alias("score"))


# --- identity, scanning, tokens ----------------------------------------------------


@register("doc_identity", f"with {DOCS} select id as doc_id, hash, docid, doc_len from docs")
def doc_identity(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.documents(spark, sf).select(F.col("id").alias("doc_id"), "hash", "docid", "doc_len")


@register(
    "title_extract",
    rf"""with {DOCS}, t as (select id, path, case when collection = 'en' then '# ' || title || chr(10) || content else content end as c from docs),
x as (select id, path, trim(regexp_extract(c, '(?m)^#\s+(.+)$', 1)) as found from t)
select id as doc_id, case when found <> '' then found else regexp_replace(split_part(path, '/', 2), '\.[^.]*$', '') end as title from x""",
)
def title_extract(spark: SparkSession, sf: str) -> DataFrame:
    """English documents are given their first line as a heading."""
    docs = adapter.documents(spark, sf)
    content = F.when(F.col("collection") == "en", F.concat(F.lit("# "), "title", F.lit("\n"), "content")).otherwise(F.col("content"))
    return docs.select(F.col("id").alias("doc_id"), text.title(content, F.col("path")).alias("title"))


@register("scan_filters", f"with {DOCS} select path, cast(strlen(content) as bigint) as size from docs where path ilike '%SRC1%' and strlen(content) <= 1048576 and instr(content, chr(0)) = 0")
def scan_filters(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    data = F.col("content").cast("binary")
    plain = F.locate("\x00", F.decode(F.substring(data, 1, 512), "ISO-8859-1")) == 0
    kept = docs.where(F.col("path").rlike(text.like_pattern("*SRC1*"))).where(F.octet_length("content") <= 1 << 20).where(plain)
    return kept.select("path", F.octet_length("content").cast("long").alias("size"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_tokens(adapter.documents(spark, sf))


@register("token_stats", statement(TOKENS, tail="select id as doc_id, " + ", ".join(f"cast(sum(len(toks)) filter (where fld = '{f}') as bigint) as n_{f}" for f in ("title", "content", "docid")) + " from tok group by 1"))
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select(F.col("id").alias("doc_id"), *(F.size(f"t_{f}").cast("long").alias(f"n_{f}") for f in ("title", "content", "docid")))


@register("doc_freq", statement(TOKENS, tail="select term, count(distinct id) as n_docs, count(*) as n_tokens from (select id, unnest(toks) as term from tok where fld = 'content') group by 1"))
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    """A posting is a document's occurrences of a term, so the index is counted as it is."""
    own = adapter.index(spark, sf).postings.where("field = 'content'")
    return own.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("n_tokens"))


@register("prefix_freq", statement(TOKENS, tail="select left(term, 2) as prefix, count(distinct id) as n_docs from (select id, unnest(toks) as term from tok) group by 1"))
def prefix_freq(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.concat("t_title", "t_content", "t_docid")
    own = _tokens(spark, sf).select("id", F.explode(F.array_distinct(F.transform(terms, lambda t: F.left(t, F.lit(2))))).alias("prefix"))
    return own.groupBy("prefix").agg(F.count("*").alias("n_docs"))


@register("avg_doc_len", f"with {DOCS} select round(coalesce(nullif(avg(doc_len), 0), 500), 6) as avg_doc_len from docs where active and doc_len > 0")
def avg_doc_len(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf).where("active and doc_len > 0")
    return docs.agg(F.round(F.coalesce(F.nullif(F.avg("doc_len"), F.lit(0.0)), F.lit(500.0)), 6).alias("avg_doc_len"))


# --- BM25 -----------------------------------------------------------------------------


def _bm25(name: str, query: str, corrected: bool = False, collection: str | None = None, intended: bool = False) -> None:
    sql = result(TOKENS, scores(parse(query), intended=intended), top("raw", "found", 10, collection, corrected), of="found")
    register(name, sql)(lambda spark, sf: ranked(search.bm25(adapter.index(spark, sf), query, collection, 10, corrected, intended)))


_bm25("bm25_single", ONE)
_bm25("bm25_and", PAIR)
_bm25("bm25_phrase", PHRASE)
_bm25("bm25_weights", TITLE)
_bm25("bm25_docid_zero", HEX)
_bm25("bm25_first", "^th")
_bm25("bm25_joined", "of+th")
_bm25("bm25_collection", PAIR, corrected=True, collection="de")
_bm25("bm25_length_corrected", PAIR, corrected=True)
_bm25("bm25_length_intended", PAIR, corrected=True, intended=True)


@register("bm25_inactive", statement(TOKENS, scores(parse(ONE)), tail="select id as doc_id, round(raw, 6) as score from raw"))
def bm25_inactive(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all active matches; inactive documents count in the statistics."""
    found, _ = search._scored(adapter.index(spark, sf), parse(ONE), False)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@register("bm25_normalized", result(TOKENS, scores(parse(PAIR)), normalized("raw", "found", 10), of="found"))
def bm25_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(search.bm25_normalized(adapter.index(spark, sf), PAIR, 10))


# --- vectors ----------------------------------------------------------------------------


def _q(n: int) -> str:
    return f"select embedding::double[] as v from embeddings where vec_id = {n}"


def _cosine(name: str, several: bool = False, collection: str | None = None, least: float = 0.0) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = adapter.documents(spark, sf)
        return ranked(search.vector_search(docs, adapter.vectors(spark, sf, docs, several), adapter.vector(spark, sf, 0), collection, 10, least))

    register(name, result(SEVERAL if several else VECTORS, nearest(_q(0), "found", 10, collection, least), of="found"))(run)


_cosine("cosine_topk")
_cosine("cosine_collection", collection="fr")
_cosine("cosine_min_score", least=0.3)


_ODD = """odd as (select hash, 0 as seq, case label % 4 when 0 then embedding[1:63]::double[] when 1 then [0.0::double for x in embedding] else embedding::double[] end as vec from docs join embeddings on vec_id = id)"""


@register("cosine_odd_vectors", statement(_ODD, tail=f"select hash, round(max(list_cosine_similarity(vec, v)), 6) as sim from odd, ({_q(0)}) where len(vec) = len(v) and list_dot_product(vec, vec) > 0 group by 1 having max(list_cosine_similarity(vec, v)) > 0"))
def cosine_odd_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of another dimension and without length among the others."""
    docs = adapter.documents(spark, sf)
    raw = adapter.read(spark, sf, "embeddings")
    vec = F.when(F.col("label") % 4 == 0, F.slice("embedding", 1, 63)).when(F.col("label") % 4 == 1, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    odd = docs.select("id", "hash").join(raw.select(F.col("vec_id").alias("id"), vec.alias("vec")), "id")
    return search.similar_chunks(odd, adapter.vector(spark, sf, 0)).select("hash", F.round("sim", 6).alias("sim"))


@register("cosine_max_per_doc", statement(SEVERAL, tail=f"select hash, round(max(list_cosine_similarity(vec::double[], v)), 6) as sim from vectors, ({_q(0)}) where vec is not null group by 1 having max(list_cosine_similarity(vec::double[], v)) > 0"))
def cosine_max_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return search.similar_chunks(adapter.vectors(spark, sf, docs, True), adapter.vector(spark, sf, 0)).select("hash", F.round("sim", 6).alias("sim"))


_CENTROID = """select list(x order by i) as v from (select i, avg(x) as x from (
  select unnest(vec::double[]) as x, unnest(range(len(vec))) as i from vectors where hash in (select hash from docs where active and docid in (select docid from seed))) group by i)"""


@register("centroid_prf", result(TOKENS, VECTORS, scores(parse(ONE)), normalized("raw", "seed", 20), nearest(_CENTROID, "near", 10), simple("seed", "near", "found", 10), of="found"))
def centroid_prf(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.index(spark, sf)
    return ranked(hybrid.feedback(docs, adapter.vectors(spark, sf, docs.documents), ONE, None, 10))


# --- fusion -----------------------------------------------------------------------------


@register("rrf_simple", result(TOKENS, VECTORS, scores(parse(PAIR)), top("raw", "words", 20), nearest(_q(0), "near", 20), simple("words", "near", "found", 10), of="found"))
def rrf_simple(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.index(spark, sf)
    near = search.vector_search(docs, adapter.vectors(spark, sf, docs.documents), adapter.vector(spark, sf, 0), None, 20)
    return ranked(search.simple_fusion(search.bm25(docs, PAIR, None, 20), near, 10))


@register("research_merge", result(TOKENS, VECTORS, scores(parse(PAIR)), normalized("raw", "words", 20), nearest(_q(0), "near", 20), simple("words", "near", "merged", 10), "found as (select * from merged where score >= 0.016)", of="found"))
def research_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.index(spark, sf)
    return ranked(hybrid.research(docs, adapter.vectors(spark, sf, docs.documents), PAIR, adapter.vector(spark, sf, 0), None, 10, 0.016))


class EmbedderOnly(StubEngine):
    """The vector of number 0 for every text."""

    has_embedder = True

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.vector = adapter.vector(spark, sf, 0)

    def embed(self, asked: str, is_query: bool) -> list[float]:
        return self.vector


@register("smart_search", result(TOKENS, VECTORS, scores(parse(PAIR)), top("raw", "words", 20), nearest(_q(0), "near", 20), simple("words", "near", "found", 10), of="found"))
def smart_search(spark: SparkSession, sf: str) -> DataFrame:
    """The command line's search with an embedder and no other model."""
    docs = adapter.index(spark, sf)
    return ranked(hybrid.smart(docs, adapter.vectors(spark, sf, docs.documents), EmbedderOnly(spark, sf), PAIR, None, 10))


_LISTS = " union all ".join(f"select '{i:03d}' as list, {w:.1f} as weight, rank, docid, path, title from {t}" for i, (t, w) in enumerate((("w1", 2), ("n1", 2), ("w2", 1), ("n2", 1))))
_HYBRID = (TOKENS, VECTORS, scores(parse(PAIR), "r1"), normalized("r1", "w1", 20), scores(parse(OTHER), "r2"), normalized("r2", "w2", 20), nearest(_q(0), "n1", 20), nearest(_q(1), "n2", 20), fused(_LISTS, "fusion", 30, True))


class TableEngine:
    """Answers from the tables: the query's vector is number 0, the expansion's 1."""

    has_embedder = has_expander = has_reranker = True

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def embed(self, asked: str, is_query: bool) -> list[float]:
        return adapter.vector(self.spark, self.sf, 0 if asked.endswith(PAIR) else 1)

    def expand(self, query: str) -> list[tuple[str, str]]:
        return [(OTHER, "lex"), ("more", "vec")]

    def rerank(self, query: str, texts) -> list[float]:
        return [0.5] * len(texts)


@register("hybrid_weighted_rrf", result(*_HYBRID, of="fusion"))
def hybrid_weighted_rrf(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.index(spark, sf)
    chunks = adapter.vectors(spark, sf, docs.documents)
    lists = []
    for query, number, weight in ((PAIR, 0, 2.0), (OTHER, 1, 1.0)):
        lists.append((search.bm25_normalized(docs, query, 20), weight))
        lists.append((search.vector_search(docs, chunks, adapter.vector(spark, sf, number), None, 20), weight))
    return ranked(hybrid.weighted_fusion(lists))


_BLEND = """mixed as (select docid, path, title, score * case when rank < 3 then 0.75 when rank < 10 then 0.6 else 0.4 end + 0.5 * case when rank < 3 then 0.25 when rank < 10 then 0.4 else 0.6 end as score from fusion),
found as (select row_number() over (order by round(score, 12) desc, docid) - 1 as rank, * from mixed order by round(score, 12) desc, docid limit 10)"""


@register("hybrid_blend_stub", result(*_HYBRID, _BLEND, of="found"))
def hybrid_blend_stub(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.index(spark, sf)
    return ranked(hybrid.hybrid(docs, adapter.vectors(spark, sf, docs.documents), TableEngine(spark, sf), PAIR, None, 10))


# --- lookups and upkeep -------------------------------------------------------------------


@register("get_by_docid", f"with {DOCS} select docid, path, title, hash from docs where active and docid = (select min(docid) from docs where active) order by path, id limit 1")
def get_by_docid(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    reference = docs.where("active").agg(F.min("docid")).first()[0]
    return lookup.get_document(docs, f"#{reference}").drop("context")


@register("get_by_path", f"with {DOCS} select docid, path, title, hash from docs where active and path = 'src3/3.md'")
def get_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.get_document(adapter.documents(spark, sf), "src3/3.md").drop("context")


@register(
    "multi_get_like",
    f"with {DOCS} select ord, docid, path, title from (select 0::bigint as ord, * from docs where path ilike 'SRC1%' union all select 1, * from docs where path ilike '%9.md' union all select 2, * from docs where path = 'src3/3.md') where active",
)
def multi_get_like(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.multi_get(adapter.documents(spark, sf), "SRC1*, *9.md, src3/3.md")
    return found.select(F.col("ord").cast("long").alias("ord"), "docid", "path", "title")


_DONE = "(select hash from vectors where vec is not null)"


@register("unembedded_hashes", statement(SEVERAL, tail=f"select distinct hash from docs where active and hash not in {_DONE}"))
def unembedded_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return lookup.unembedded(docs, adapter.vectors(spark, sf, docs, True))


@register("unembedded_chunks", statement(SEVERAL, tail="select hash, seq, cast(0 as int) as pos from vectors where vec is null and hash = (select min(hash) from vectors where vec is null)"))
def unembedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that one content still lacks a vector for."""
    chunks = adapter.vectors(spark, sf, adapter.documents(spark, sf), True)
    first = chunks.where("vec is null").agg(F.min("hash")).first()[0]
    left = lookup.unembedded_chunks(chunks.withColumn("text", F.col("hash")), first)
    return left.select(F.col("text").alias("hash"), F.col("seq").cast("long").alias("seq"), F.lit(0).alias("pos"))


@register("document_for_hash", f"with {DOCS} select title, collection || '/' || path as path from docs where active and hash = (select max(hash) from docs where active) order by collection, path limit 1")
def document_for_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return lookup.document_for_hash(docs, docs.where("active").agg(F.max("hash")).first()[0])


@register("unembedded_count", statement(SEVERAL, tail=f"select count(distinct hash) as n from docs where active and hash not in {_DONE}"))
def unembedded_count(spark: SparkSession, sf: str) -> DataFrame:
    return unembedded_hashes(spark, sf).agg(F.count("*").alias("n"))


@register("partial_embedded", statement(SEVERAL, tail="select hash, count(*) as n_chunks, count(vec) as n_vectors from vectors group by 1 having count(vec) between 1 and count(*) - 1"))
def partial_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that count as embedded though some chunk has no vector."""
    docs = adapter.documents(spark, sf)
    counts = adapter.vectors(spark, sf, docs, True).groupBy("hash").agg(F.count("*").alias("n_chunks"), F.count("vec").alias("n_vectors"))
    return counts.where("n_vectors between 1 and n_chunks - 1")


_SCAN = """scan as (select collection, path, sha256(case when collection = 'es' then content || '!' else content end) as hash from docs where collection <> 'fr')"""


def _scan(docs: DataFrame) -> DataFrame:
    """A scan that misses the French documents and finds the Spanish ones changed."""
    content = F.when(F.col("collection") == "es", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return docs.where("collection <> 'fr'").select("collection", "path", text.content_hash(content).alias("hash"))


@register("stale_paths", statement(_SCAN, tail="select collection, path from docs where active and (collection, path) not in (select (collection, path) from scan)"))
def stale_paths(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return lookup.stale_paths(docs, _scan(docs))


@register("change_detect", statement(_SCAN, tail="select collection, path, case when scan.hash is null then 'missing' when scan.hash = docs.hash then 'unchanged' else 'changed' end as status from docs left join scan using (collection, path)"))
def change_detect(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return lookup.change_status(docs, _scan(docs))


@register(
    "upsert_merge",
    statement(
        _SCAN,
        tail="""select id, collection, path, case when scan.hash <> docs.hash then scan.hash else docs.hash end as hash,
case when scan.hash is null then false when scan.hash <> docs.hash then true else active end as active from docs left join scan using (collection, path)""",
    ),
)
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return lookup.merge(docs.select("id", "collection", "path", "hash", "active"), _scan(docs))


@register("stale_observations", statement(_SCAN, tail="""select docid, path, 'note' as note from (select distinct docid, path, hash from docs) n
where not exists (select 1 from (select d.docid, min_by(s.hash, d.path) as now from docs d join scan s using (collection, path) where active group by 1) c where c.docid = n.docid and c.now = n.hash)"""))
def stale_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on all documents, after the scan above."""
    docs = adapter.documents(spark, sf)
    notes = docs.select("docid", "path", "hash", F.lit("note").alias("note")).distinct()
    scanned = _scan(docs).withColumnRenamed("hash", "new")
    now = docs.join(scanned, ["collection", "path"]).drop("hash").withColumnRenamed("new", "hash")
    return lookup.stale_notes(notes, now).select("docid", "path", "note")


@register("attach_notes", statement(_SCAN, "stale as (select distinct docid from docs join scan using (collection, path) where docs.hash <> scan.hash)", tail="select id as doc_id, d.docid, case when s.docid is null then '' else ' [STALE observation: ' || 'note on ' || d.docid || ']' end as context from docs d left join stale s using (docid)"))
def attach_notes(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as results, tagged with the notes that the scan above made stale."""
    docs = adapter.documents(spark, sf)
    changed = docs.join(_scan(docs).withColumnRenamed("hash", "new"), ["collection", "path"]).where(F.col("hash") != F.col("new"))
    stale = changed.select("docid", F.concat(F.lit("note on "), "docid").alias("note"))
    return lookup.attach_notes(docs.select("id", "docid", "context"), stale).select(F.col("id").alias("doc_id"), "docid", "context")


@register("index_status", statement(SEVERAL, tail=f"""select (select count(distinct collection) from docs) as collections, (select count(*) from docs) as documents, (select count(*) from vectors) as chunks,
(select count(distinct hash) from docs where active and hash not in {_DONE}) as needs_embedding,
(select count(distinct hash) from docs where active and hash not in {_DONE}) = 0 and (select count(*) from vectors) > 0 as has_vector_index"""))
def index_status(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapter.documents(spark, sf)
    return lookup.status(adapter.collections(docs), docs, adapter.vectors(spark, sf, docs, True))


@register("active_collections", f"with {DOCS} select distinct collection from docs where active")
def active_collections(spark: SparkSession, sf: str) -> DataFrame:
    return search.active_collections(adapter.documents(spark, sf))


# --- structure ----------------------------------------------------------------------------

_TRIMMED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@register(
    "break_score",
    f"""with {DOCS}, lines as (select id, unnest(string_split(content, chr(10))) as line from docs), t as (select id, {_TRIMMED} as l from lines)
select id as doc_id, count(*) as n_lines, cast(sum(case when starts_with(l, '# ') then 100 when starts_with(l, '## ') then 90 when starts_with(l, '### ') or starts_with(l, '```') then 80 when starts_with(l, '#### ') then 70
 when starts_with(l, '##### ') or starts_with(l, '---') or starts_with(l, '***') then 60 when starts_with(l, '###### ') then 50 when l = '' then 20
 when starts_with(l, '- ') or starts_with(l, '* ') or regexp_matches(l, '^[0-9]+\\.\\s') then 5 else 1 end) as bigint) as total from t group by 1""".replace("\\\\", "\\"),
)
def break_score(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the lines' scores for each document."""
    lines = F.split("content", "\n")
    total = F.aggregate(F.transform(lines, text.break_score_column), F.lit(0), lambda a, x: a + x)
    return adapter.documents(spark, sf).select(F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), total.cast("long").alias("total"))


@register("chunk_documents", chunks.SQL)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunker.chunk_documents(adapter.documents(spark, sf))


@register("porter_terms", statement(TOKENS, "terms as (select distinct unnest(toks) as term from tok where fld = 'content')", stems("terms"), tail="select term, stem from stemmed"))
def porter_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct term with its stem."""
    terms = adapter.index(spark, sf).postings.where("field = 'content'").select("term").distinct()
    return terms.select("term", stem("term").alias("stem"))


def _stemmed(name: str, query: str) -> None:
    sql = result(STEMMED_TOKENS, scores(parse(query, True)), top("raw", "found", 10), of="found")
    register(name, sql)(lambda spark, sf: ranked(search.bm25(adapter.index(spark, sf, True), query, None, 10, stemmed=True)))


_stemmed("bm25_porter", PAIR)
_stemmed("bm25_porter_phrase", PHRASE)


_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"


def _unmarked() -> str:
    """CTEs m0, m1, ... that take one of the marks after the other off the lines of ``asked``."""
    names = ["asked", *(f"m{k}" for k in range(len(LINE_MARKS)))]
    return ",\n".join(
        f"{out} as (select item_id, orig, i, case when starts_with(l, '{mark}') then substr(l, {len(mark) + 1}) else l end as l from {before})"
        for before, out, mark in zip(names, names[1:], LINE_MARKS)
    )


@register(
    "expand_parse",
    f"""with texts as (select item_id, coalesce(text, '') as t from benchmark),
cut as (select item_id, split_part(t, chr(10), 1) as orig, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as i from texts),
asked as (select item_id, orig, i, trim(l, {_BLANK}) as l from cut where trim(l, {_BLANK}) <> '' and trim(l, {_BLANK}) <> orig),
{_unmarked()},
found as (select item_id, orig, i, trim(l, {_BLANK}) as l from m{len(LINE_MARKS) - 1} where trim(l, {_BLANK}) <> '' and trim(l, {_BLANK}) <> orig),
filled as (select item_id, l as query, i from found union all select item_id, split_part(t, chr(10), 1), 1e9 from texts union all select item_id, split_part(t, chr(10), 1), 2e9 from texts),
numbered as (select item_id, query, row_number() over (partition by item_id order by i) as k from filled)
select item_id, query, case k when 1 then 'lex' else 'vec' end as kind from numbered where k <= 2""",
)
def expand_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text taken for a model's answer to its first line."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(i, q, kind) for i, t in zip(pdf["item_id"], pdf["text"]) for q, kind in expansions(t or "", (t or "").split("\n")[0])]
            yield pd.DataFrame(rows, columns=["item_id", "query", "kind"])

    return adapter.read(spark, sf, "benchmark").mapInPandas(run, "item_id long, query string, kind string")


@register("vec_codec_roundtrip", "select vec_id, embedding as vec, cast(4 * len(embedding) as bigint) as n_bytes from embeddings")
def vec_codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    packed = adapter.read(spark, sf, "embeddings").select("vec_id", vectors.pack("embedding").alias("data"))
    return packed.select("vec_id", vectors.unpack("data").alias("vec"), F.octet_length("data").cast("long").alias("n_bytes"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
