"""The chunks of every content as DuckDB SQL: a recursion that takes one line a step."""

from __future__ import annotations

from quarry.operators.chunker import LOOK_BACK, OVERLAP, TARGET
from quarry.plans.adapter import DOCS

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINE = _TRIM.format("x")
_SCORE = rf"""case when starts_with({_LINE}, '# ') then 100 when starts_with({_LINE}, '## ') then 90 when starts_with({_LINE}, '### ') or starts_with({_LINE}, '```') then 80
  when starts_with({_LINE}, '#### ') then 70 when starts_with({_LINE}, '##### ') or starts_with({_LINE}, '---') or starts_with({_LINE}, '***') then 60 when starts_with({_LINE}, '###### ') then 50
  when {_LINE} = '' then 20 when starts_with({_LINE}, '- ') or starts_with({_LINE}, '* ') or regexp_matches({_LINE}, '^[0-9]+\.\s') then 5 else 1 end"""


def _fence(line: str) -> str:
    return f"starts_with({_TRIM.format(line)}, '```')"


def _tail(lines: str) -> str:
    """The last of ``lines`` that reach the overlap together, joined."""
    from_here = f"list_sum(list_transform({lines}[a + 1:], lambda t: length(t) // 4))"
    at = f"coalesce(list_max(list_filter(range(0, len({lines})), lambda a: {from_here} >= {OVERLAP})), 0)"
    return f"array_to_string({lines}[{at} + 1:], chr(10))"


#: The best of the last lines to cut before: later ones need only reach the whole part of
#: the best score so far; lines inside a fence do not count.
_CUT = f"""list_reduce(list_prepend({{'best': 0.0::double, 'cut': 0::bigint, 'score': 0.0::double}}, list_transform(range(greatest(1, len(ls) - {LOOK_BACK}), len(ls)), lambda j: {{'best': 0.0::double, 'cut': j,
  'score': case when len(list_filter(ls[1:j], lambda y: {_fence("y")})) % 2 = 1 then -1.0::double
    else scores[j + 1] * (1 - ((len(ls) - j) / (len(ls) - greatest(1, len(ls) - {LOOK_BACK}) + 1)::double) * ((len(ls) - j) / (len(ls) - greatest(1, len(ls) - {LOOK_BACK}) + 1)::double) * 0.7::double) end}})),
  lambda a, b: case when b.score >= a.best then {{'best': trunc(b.score), 'cut': b.cut, 'score': 0.0::double}} else a end)"""

SQL = f"""with recursive {DOCS},
texts as (select hash, string_split(any_value(content), chr(10)) as all_lines from docs group by hash),
steps as (
  select hash, 0::bigint as i, '' as held, 0::bigint as size, 0::bigint as pos, '' as pending, false as fenced, cast(null as varchar) as said, 0::bigint as said_pos from texts
  union all
  select hash, i + 1,
    case when go then case when held = '' and pending <> '' then pending || chr(10) else held end || line || chr(10)
      when cut > 0 then case when tail <> '' then tail || chr(10) else '' end || array_to_string(ls[cut + 1:], chr(10)) || chr(10) || line
      else case when tail <> '' then tail || chr(10) else '' end end,
    case when go then case when held = '' and pending <> '' then length(pending || chr(10)) // 4 else sized end
      when cut > 0 then length(case when tail <> '' then tail || chr(10) else '' end || array_to_string(ls[cut + 1:], chr(10)) || chr(10) || line) // 4
      else length(case when tail <> '' then tail || chr(10) else '' end) // 4 end,
    case when go then case when held = '' then i else pos end when cut > 0 then i - (len(ls) - cut) else i + 1 end,
    case when go then case when held = '' then '' else pending end else tail end,
    within, case when go then null when cut > 0 then array_to_string(ls[1:cut], chr(10)) else held || line || chr(10) end, pos
  from (select *, case when go then '' when cut > 0 then {_tail("ls[1:cut]")} else {_tail("string_split(held || line || chr(10), chr(10))")} end as tail
    from (select *, case when go or best.best <= 1 then 0 else best.cut end as cut
      from (select *, case when go then null else {_CUT} end as best
        from (select *, case when go then [] else string_split(held, chr(10)) end as ls, case when go then [] else list_transform(string_split(held, chr(10)), lambda x: {_SCORE}) end as scores
          from (select *, sized < {TARGET} or within as go
            from (select s.*, all_lines[i + 1] as line, fenced <> {_fence("all_lines[i + 1]")} as within, size + length(all_lines[i + 1]) // 4 as sized
              from steps s join texts using (hash) where i < len(all_lines)))))))
),
said_all as (select hash, i, said_pos as pos, {_TRIM.format("said")} as t from steps where said is not null
  union all select hash, i + 1, pos, {_TRIM.format("held")} from steps join texts using (hash) where i = len(all_lines))
select hash, cast(row_number() over (partition by hash order by i) - 1 as int) as seq, cast(pos as int) as pos, t as text from said_all where t <> ''"""
