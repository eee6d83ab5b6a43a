"""Building blocks of the DuckDB statements that the registered queries are held to."""

from __future__ import annotations

from collections.abc import Sequence

from quarry.operators.query import Phrase
from quarry.plans.adapter import DOCS

TOKENS = r"""tok as (select id, fld, w, list_transform(regexp_extract_all(lower(s), '[\p{L}\p{N}\p{Co}]+'), lambda x: strip_accents(x)) as toks
  from (select id, unnest(['title', 'content', 'docid']) as fld, unnest([5.0, 1.0, 0.0]) as w, unnest([title, content, docid]) as s from docs)),
dl as (select id, sum(len(toks))::double as d from tok group by 1),
st as (select count(*)::double as n_rows, avg(d) as avgdl from dl),
al as (select coalesce(nullif(avg(doc_len), 0), 500) as l from docs where active and doc_len > 0)"""

FACTOR = "(0.45 + 0.55 * doc_len / l) / (0.25 + 0.75 * doc_len / l)"
INTENDED = "(0.25 + 0.75 * doc_len / l) / (0.45 + 0.55 * doc_len / l)"


def _count(phrase: Phrase) -> str:
    terms = [t.replace("'", "''") for t in phrase.terms]
    last = "starts_with({}, '{}')" if phrase.prefix else "{} = '{}'"
    if phrase.first:
        tests = [f"toks[{k + 1}] = '{t}'" for k, t in enumerate(terms[:-1])] + [last.format(f"toks[{len(terms)}]", terms[-1])]
        return f"cast(coalesce({' and '.join(tests)}, false) as int)"
    if len(terms) == 1:
        return f"len(list_filter(toks, lambda x: {last.format('x', terms[0])}))"
    tests = [f"toks[i + {k}] = '{t}'" for k, t in enumerate(terms[:-1])] + [last.format(f"toks[i + {len(terms) - 1}]", terms[-1])]
    return f"len(list_filter(range(1, len(toks) - {len(terms) - 2}), lambda i: {' and '.join(tests)}))"


def scores(phrases: Sequence[Phrase], name: str = "raw", intended: bool = False) -> str:
    """CTE with raw and corrected scores of the active documents that hold all phrases."""
    parts = []
    for i, p in enumerate(phrases):
        where = f" where fld = '{p.field}'" if p.field else ""
        parts.append(f"select {i} as i, id, w, {_count(p)} as h from tok{where}")
    n = len(phrases)
    return f"""{name}_h as (select i, id, sum(w * h)::double as f from ({' union all '.join(parts)}) where h > 0 group by 1, 2),
{name}_v as (select i, ln(((select n_rows from st) - count(*) + 0.5) / (count(*) + 0.5)) as v from {name}_h group by 1),
{name}_i as (select i, case when v <= 0 then 1e-6 else v end as v from {name}_v),
{name}_s as (select id, sum(v * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / (select avgdl from st)))) as raw
  from {name}_h join {name}_i using (i) join dl using (id) group by 1 having count(*) = {n}),
{name} as (select docs.*, raw, raw * case when doc_len > 0 then {INTENDED if intended else FACTOR} else 1 end as corrected from {name}_s join docs using (id), al where active)"""


def top(name: str, out: str, limit: int, collection: str | None = None, corrected: bool = True) -> str:
    """CTE with the plain ranking."""
    where = f" where collection = '{collection}'" if collection else ""
    score = "corrected" if corrected else "raw"
    return f"""{out} as (select row_number() over (order by {score} desc, docid, path) - 1 as rank, docid, path, title, {score} as score
  from (select * from {name}{where} order by raw desc, docid, path limit {limit}))"""


def fused(lists: str, out: str, limit: int, bonus: bool = False) -> str:
    """CTE that fuses rows (list, weight, rank, docid, path, title)."""
    more = " + case when rank = 0 then 0.05 when rank <= 2 then 0.02 else 0 end" if bonus else ""
    return f"""{out} as (select row_number() over (order by round(score, 12) desc, docid) - 1 as rank, docid, p.path as path, p.title as title, score from (
  select docid, sum(weight / (61.0 + rank){more}) as score, arg_min({{'path': path, 'title': title}}, {{'list': list, 'rank': rank, 'path': path}}) as p
  from ({lists}) group by docid) order by round(score, 12) desc, docid limit {limit})"""


def normalized(name: str, out: str, limit: int) -> str:
    return f"""{out}_l as (select collection as list, 1.0 as weight, row_number() over (partition by collection order by corrected desc, docid, path) - 1 as rank, docid, path, title
  from (select *, row_number() over (partition by collection order by raw desc, docid, path) as k from {name}) where k <= {limit}),
""" + fused(f"select * from {out}_l", out, limit)


def nearest(query: str, out: str, limit: int, collection: str | None = None, least: float = 0.0) -> str:
    """CTE with the vector ranking; ``query`` is a subquery giving one double[] ``v``."""
    own = f" and hash in (select hash from docs where active and collection = '{collection}')" if collection else ""
    return f"""{out}_s as (select hash, max(list_cosine_similarity(vec::double[], v)) as sim from vectors, ({query}) where vec is not null{own} group by 1),
{out}_t as (select * from {out}_s where sim > 0 order by sim desc, hash limit {limit}),
{out}_d as (select hash, docid, path, title, row_number() over (partition by hash order by path, id) as k from docs where active),
{out} as (select row_number() over (order by sim desc, hash) - 1 as rank, docid, path, title, sim as score from {out}_d join {out}_t using (hash) where k = 1 and sim >= {least})"""


def simple(words: str, vectors: str, out: str, limit: int) -> str:
    lists = f"select 'a' as list, 1.0 as weight, rank, docid, path, title from {words} union all select 'b', 1.0, rank, docid, path, title from {vectors}"
    return fused(lists, f"{out}_f", limit) + f""",
{out}_w as (select docid, arg_max({{'path': path, 'title': title}}, rank) as o from {words} group by 1),
{out} as (select rank, docid, coalesce(o.path, path) as path, coalesce(o.title, title) as title, score from {out}_f left join {out}_w using (docid))"""


RESULT = "cast(rank as bigint) as rank, docid, path, title, round(score, 6) as score"


def statement(*ctes: str, tail: str) -> str:
    return "with " + ",\n".join((DOCS, *ctes)) + f"\n{tail}"


def result(*ctes: str, of: str) -> str:
    return statement(*ctes, tail=f"select {RESULT} from {of}")
