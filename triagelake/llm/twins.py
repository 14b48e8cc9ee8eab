"""DuckDB twins of operators whose whole result SQL can say, and queries of the
fixed columns of two whose other columns it cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .op1_mixing import CAP, WEIGHTS, mix
from .op6_suffix import MATCH
from .op7_url_tree import RULES, judge

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix, and whether what a source takes is within
    its longest document of the target and no document is taken too often."""
    out = mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.selectExpr("doc_id", "size", "source_size", "round(target, 3) AS target", f"taken <= {CAP} * size AS within_cap")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule fits."""
    out = judge(read(spark, sf_dir, "pages", "page_id", "url"))
    return out.selectExpr("page_id", "host", "path", "rule", "CASE WHEN rule IS NOT NULL THEN verdict END AS ruled")


def _closure(links: str) -> str:
    """CTE ``comp`` (id, low): the smallest id reachable over a table of links
    that holds both directions and every id with itself."""
    return f"""
reach(id, other) as (select x, y from {links} union select r.id, l.y from reach r join {links} l on l.x = r.other),
comp as (select id, min(other) as low from reach group by id)"""


OP4_SQL = f"""
with recursive w as (
select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as (
select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
       else list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))) end as sh from w),
one as (select doc_id, unnest(sh) as g from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from one a join one b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
linked as (select x, y from pairs join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * c >= 85 * (len(a.sh) + len(b.sh) - c)),
links as (select x, y from linked union all select y, x from linked union all select doc_id, doc_id from sets),
{_closure('links')}
select doc_id, len(sh)::bigint as n_shingles, low as component_id from sets join comp on id = doc_id"""

#: Every window of 200 bytes by its MD5, from blocks of 2,048 starts; the rest of
#: a text is what lies between the covered runs.
OP6_SQL = f"""
with t as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select *, len(h) // 2 as n from t),
b as (select r, n, s, substr(h, 2 * s + 1, {2 * (2048 + MATCH - 1)}) as part from (select r, n, h, unnest(generate_series(0, n - {MATCH}, 2048)) as s from n where n >= {MATCH})),
w as (select r, s + i as pos, md5(substr(part, 2 * i + 1, {2 * MATCH})) as m from (select r, s, part, unnest(generate_series(0, least(2047, n - {MATCH} - s))) as i from b)),
twice as (select m from w group by m having count(*) > 1),
hit as (select r, pos from w where m in (select m from twice)),
runs as (select r, pos, sum(case when pos <= before + {MATCH} then 0 else 1 end) over (partition by r order by pos) as k
         from (select *, lag(pos) over (partition by r order by pos) as before from hit)),
spans as (select r, k, min(pos) as a, max(pos) + {MATCH} as z from runs group by r, k),
cut as (select r, sum(z - a) as removed, count(*) as spans from spans group by r),
gaps as (select r, a, coalesce(lag(z) over (partition by r order by a), 0) as from_, a as to_ from spans
         union all select n.r, n.n, max(z), n.n from spans join n using (r) group by n.r, n.n),
rest as (select g.r, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' order by from_) as kept from gaps g join n using (r) group by g.r)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, h))) as kept_sha256
from n left join cut using (r) left join rest using (r)"""

OP10_SQL = f"""
with recursive v as (
select vec_id, label, embedding::double[] as e, len(embedding) as n, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm from embeddings),
fine as (select * from v where n > 0 and label is not null and norm > 0 and isfinite(norm) and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
linked as (
select a.vec_id as x, b.vec_id as y from fine a join fine b on a.label = b.label and a.n = b.n and a.vec_id < b.vec_id
where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
links as (select x, y from linked union all select y, x from linked union all select vec_id, vec_id from embeddings),
{_closure('links')}
select vec_id, count(l.y) - 1 as n_links, low as component_id, vec_id = low as kept
from embeddings join links l on l.x = vec_id join comp on id = vec_id group by vec_id, low"""

_WEIGHT = "case (r - 1) % 3 " + " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS)) + " end"

#: Targets by rounds: a source whose share is above its cap is set to it, and
#: what is left is shared by weight; as many rounds as there are sources.
MIX_TARGETS_SQL = f"""
with recursive d as (
select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
src as (select source, sum(size)::double as s, row_number() over (order by source nulls last) as r from d group by source),
n as (select count(*) as n, sum(s) as total from src),
state(step, r, s, w, full_) as (
select 0, r, s, {_WEIGHT}::double, false from src
union all
select step + 1, r, s, w, full_ or w * free / weights > {CAP} * s
from (select *, (select total from n) - coalesce(sum(case when full_ then {CAP} * s end) over (), 0) as free,
             sum(case when full_ then 0 else w end) over () as weights from state) where step < (select n from n)),
last as (select * from state where step = (select n from n)),
target as (
select r, case when full_ then {CAP} * s else w * ((select total from n) - (select coalesce(sum({CAP} * s), 0) from last where full_))
       / (select sum(w) from last where not full_) end as target from last)
select doc_id, size::bigint as size, s::bigint as source_size, round(target, 3) as target, true as within_cap
from d join src on src.source is not distinct from d.source join target using (r)"""


def _fits(rule: str) -> str:
    name, slash, prefix = rule.partition("/")
    return f"((host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{prefix}'))"


_BY_LENGTH = sorted(RULES, key=lambda r: (-len(r[1]), r[1].encode()))

URL_RULES_SQL = f"""
with p as (select page_id, coalesce(regexp_extract(url, '(?s)^(?:.*?)://(.*)$', 1), '') as rest from pages),
hp as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
              regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from p),
ruled as (select *, case {' '.join(f"when {_fits(r)} then '{r}'" for _, r in _BY_LENGTH)} end as rule from hp)
select page_id, host, path, rule, case {' '.join(f"when rule = '{r}' then '{v}'" for v, r in RULES)} end as ruled from ruled"""
