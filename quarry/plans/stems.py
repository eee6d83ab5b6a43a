"""Porter's algorithm and stemmed tokens as DuckDB SQL, step by step over distinct terms."""

from __future__ import annotations

from quarry.functions.text import _STEP2, _STEP3, _STEP4
from quarry.plans.oracle import TOKENS

_RUNS_OF_Y = 8


def _shape(word: str) -> str:
    """``A`` for a vowel and ``B`` for a consonant; y is a vowel after a consonant."""
    out = f"regexp_replace(regexp_replace(translate({word}, 'aeiou', 'AAAAA'), '[^Ay]', 'B', 'g'), '^y', 'B')"
    for _ in range(_RUNS_OF_Y):
        out = f"replace(replace({out}, 'By', 'BA'), 'Ay', 'AB')"
    return out


def _measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'A+B'))"


def _closed(shape: str, word: str) -> str:
    return f"({shape} like '%BAB' and right({word}, 1) not in ('w', 'x', 'y'))"


def _cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _suffixes(before: str, out: str, table: dict[str, str]) -> str:
    """Two CTEs: the longest suffix of ``table`` goes over if the measure of the rest is above 0."""
    known = "|".join(table)
    new = " ".join(f"when '{end}' then '{to}'" for end, to in table.items())
    return f"""{out}_a as (select term, w, regexp_extract(w, '(?:{known})$') as e from {before}),
{out} as (select term, case when e <> '' and {_measure(_shape("left(w, length(w) - length(e))"))} > 0 then left(w, length(w) - length(e)) || case e {new} end else w end as w from {out}_a)"""


def stems(terms: str) -> str:
    """CTEs that end in ``stemmed`` (term, stem) for the rows (term) of ``terms``."""
    twice = "length(rest) > 1 and right(rest, 1) = right(left(rest, length(rest) - 1), 1) and right(sh, 1) = 'B' and right(rest, 1) not in ('l', 's', 'z')"
    return f"""p0 as (select distinct term, term as w from {terms} where strlen(term) between 3 and 64),
p1 as (select term, case when w like '%sses' or w like '%ies' then {_cut("w", 2)} when w like '%ss' then w when w like '%s' then {_cut("w", 1)} else w end as w from p0),
p2_a as (select term, w, w like '%eed' as eed, case when w like '%eed' then '' when w like '%ed' then {_cut("w", 2)} when w like '%ing' then {_cut("w", 3)} else '' end as rest from p1),
p2_b as (select *, {_shape("rest")} as sh from p2_a),
p2 as (select term, case when eed then case when {_measure(_shape(_cut("w", 3)))} > 0 then {_cut("w", 1)} else w end
  when sh not like '%A%' then w when right(rest, 2) in ('at', 'bl', 'iz') then rest || 'e' when {twice} then {_cut("rest", 1)}
  when {_measure("sh")} = 1 and {_closed("sh", "rest")} then rest || 'e' else rest end as w from p2_b),
p3 as (select term, case when w like '%y' and {_shape(_cut("w", 1))} like '%A%' then {_cut("w", 1)} || 'i' else w end as w from p2),
{_suffixes("p3", "p4", _STEP2)},
{_suffixes("p4", "p5", _STEP3)},
p6_a as (select term, w, regexp_extract(w, '(?:{"|".join(_STEP4)})$') as e from p5),
p6_b as (select *, left(w, length(w) - length(e)) as rest from p6_a),
p6 as (select term, case when e <> '' and {_measure(_shape("rest"))} > 1 and (e <> 'ion' or right(rest, 1) in ('s', 't')) then rest else w end as w from p6_b),
p7_a as (select term, w, case when w like '%e' then {_cut("w", 1)} else '' end as rest from p6),
p7_b as (select *, {_shape("rest")} as sh from p7_a),
p7 as (select term, case when {_measure("sh")} > 1 or {_measure("sh")} = 1 and not {_closed("sh", "rest")} then rest else w end as w from p7_b),
p8 as (select term, case when w like '%ll' and {_measure(_shape(_cut("w", 1)))} > 1 then {_cut("w", 1)} else w end as w from p7),
stemmed as (select distinct t.term, coalesce(p8.w, t.term) as stem from {terms} t left join p8 using (term))"""


_PLAIN, _REST = TOKENS.split("\ndl as", 1)
#: ``TOKENS`` with stems in place of the tokens.
STEMMED_TOKENS = f"""{_PLAIN.replace("tok as (", "plain_tok as (", 1)}
each_tok as (select id, fld, w, unnest(toks) as term, generate_subscripts(toks, 1) as i from plain_tok),
{stems("each_tok")},
tok as (select id, fld, w, list(stem order by i) as toks from each_tok join stemmed using (term) group by 1, 2, 3),
dl as{_REST}"""
