"""The queries of ``queries.py`` as DuckDB SQL over the same tables."""

from __future__ import annotations

from webloom import queries as Q
from webloom.functions import stem as S
from webloom.functions.text import STOP_WORDS
from webloom.schemas import MAX_ID, NIL_ID
from webloom.sources import derived as D


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ts(moment) -> str:
    return f"timestamp '{moment}'"


# Patterns of the checks, apart from those of the library.  The tables hold these four references only.
ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
TITLE = "(?is)<title[^>]*>(.*?)</title>"
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
INVISIBLE = "(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
TAG = "<[^>]*>"


def range_bounds(first: str, last: str, parts: int) -> list[tuple[str, str]]:
    """Cuts of the id space at multiples of its whole part; ``last`` is the end of the last one."""
    cuts = [f"{(1 << 128) // parts * k:032x}" for k in range(1, parts)]
    ids = [first, *(f"{c[:8]}-{c[8:12]}-{c[12:16]}-{c[16:20]}-{c[20:]}" for c in cuts), last]
    return list(zip(ids[:-1], ids[1:]))


NEVER = "timestamp '1970-01-01 00:00:00'"
START = "timestamp '2024-01-01 00:00:00'"
AS_OF = ts(D.AS_OF)
SCHEME = lit("^[A-Za-z][A-Za-z0-9+.-]*:")


# -- expressions ---------------------------------------------------------------


def uuid(key: str) -> str:
    return f"regexp_replace(md5({key}),'(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})','\\1-\\2-\\3-\\4-\\5')"


def web(url: str) -> str:
    return (
        f"coalesce(regexp_matches({url},'^[Hh][Tt][Tt][Pp][Ss]?:')"
        f" and not regexp_matches({url},'[\\x00-\\x1f\\x7f]')"
        f" and not regexp_matches({url},'^[^?#]*%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')"
        f" and not regexp_matches({url},'^[^:]*://[^/?#]* '),false)"
    )


def norm(url: str) -> str:
    bare = f"regexp_replace({url},'(?s)#.*$','')"
    scheme = f"regexp_extract({bare},{SCHEME})"
    return f"(lower({scheme}) || substr({bare},length({scheme})+1))"


def entities(text: str) -> str:
    for entity, char in ENTITIES:
        text = f"replace({text},{lit(entity)},{lit(char)})"
    return text


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text},'[ \\t\\r\\n\\f]+',' ','g'))"


def resolve(href: str, base: str) -> str:
    h = f"trim({href})"
    page = f"regexp_replace({base},'(?s)[?#].*$','')"
    origin = f"regexp_extract({page},'^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')"
    folder = f"regexp_extract(substr({page},length({origin})+1),'^/.*/|^/')"
    return norm(
        f"""(case when regexp_matches({h},{SCHEME}) then {h}
        when {h} like '//%' then lower(regexp_extract({page},{SCHEME})) || {h}
        when {h} like '/%' then {origin} || {h}
        when {h} = '' or {h} like '#%' then {base}
        when {h} like '?%' then {page} || {h}
        else {origin} || coalesce(nullif({folder},''),'/') || {h} end)"""
    )


def escape(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = f"replace({text},{lit(char)},{lit(entity)})"
    return text


def em(text: str, terms: list[str]) -> str:
    for term in terms:
        text = f"regexp_replace({text},'(?i){term}','<em>\\0</em>','g')"
    return text


# -- pages -----------------------------------------------------------------------

HREFS = f"regexp_extract_all(regexp_replace(html,{lit(INVISIBLE)},' ','g'),{lit(HREF)},1)"
UNQUOTED = f"list_transform({HREFS}, lambda h: {entities(chr(40) + 'regexp_replace(h,' + lit(chr(94) + chr(91) + chr(34) + chr(39) + chr(93) + '|[' + chr(34) + chr(39) + ']$') + ',' + lit('') + ',' + lit('g') + '))')})"

# page: one row a fetched page; found: its links in page order; link, edge: the
# tables derived from them.
PAGE = f"""
raw as (select page_id, url as raw_url, html, {norm('url')} as url from pages where {web('url')}),
href as (select page_id, raw_url, unnest(hs) h, unnest(range(len(hs))) n from
  (select page_id, raw_url, {UNQUOTED} hs from raw)),
target as (select page_id, {resolve('h', 'raw_url')} url, n from href),
found as (select page_id, url, min(n) n from target where {web('url')} group by page_id, url),
page as (select {uuid('url')} link_id, url,
  {squeeze(entities(f'regexp_extract(html,{lit(TITLE)},1)'))} title,
  {squeeze(entities(f"regexp_replace(regexp_replace(html,{lit(INVISIBLE)},' ','g'),{lit(TAG)},' ','g')"))} content,
  (select list(f.url order by f.n) from found f where f.page_id = raw.page_id) found_urls,
  page_id, {START} + to_hours(page_id::int) fetched_at from raw),
flat as (select link_id, unnest(found_urls) url, fetched_at from page)
"""
ROOT = "(regexp_extract(url,'^[a-z]+://[^/?]*') || '/')"
GRAPH = f"""{PAGE},
times as (select url, fetched_at t from page union all select url, {NEVER} from flat
  union all select {ROOT}, {NEVER} from page),
link as (select {uuid('url')} id, url, max(t) retrieved_at from times group by url),
found_edge as (select link_id src, {uuid('url')} dst, fetched_at t from flat),
root_edge as (select link_id src, {uuid(ROOT)} dst, fetched_at t from page),
edge as (select {uuid("src || '>' || dst")} id, src, dst, max(t) update_at from
  (select * from found_edge union all select dst, src, t from found_edge union all select * from root_edge)
  group by src, dst),
lost as (select src, dst, {uuid("'lost' || src")} gone from found_edge),
batch as (select src, dst from found_edge union select src, gone from lost union select gone, dst from lost
  union select dst, src from root_edge),
cutoff as (select link_id src, max({START} + to_hours((page_id * 7 % 300)::int)) cutoff from page group by link_id),
old_doc as (select link_id, url, 'old ' || min(page_id) title, null::varchar content, min(fetched_at) indexed_at,
  min(page_id) / 1000.0::double pagerank from page group by link_id, url)
"""
NTH = "{START} + to_hours((page_id * 7 % 300)::int)"

# -- search corpus ----------------------------------------------------------------

DOC = f"""
doc as (select {uuid("'doc' || doc_id")} link_id, 'https://docs.example/' || doc_id url,
  split_part(text, chr(10), 1) title, text as content, {START} + to_minutes(doc_id::int) indexed_at,
  (doc_id % 97) / 97.0::double pagerank from documents)
"""
WORDS = f"""{DOC},
tok as (select link_id, unnest(l) word, unnest(range(len(l))) pos from
  (select link_id, regexp_extract_all(lower(coalesce(title,'') || ' ' || coalesce(content,'')),'[\\p{{L}}\\p{{N}}]+') l from doc))
"""


def _suffixes(suffixes) -> str:
    return "(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$"


def _swap(table: dict[str, str]) -> str:
    whens = " ".join(f"when {lit(a)} then {lit(b)}" for a, b in table.items())
    return f"case suf {whens} end"


def stem_ctes(source: str) -> str:
    """CTEs that end in ``stems(word, stem)`` for the distinct words of ``source``."""
    rest = "left(w, length(w) - length(suf))"
    before = "left(w, length(w) - 1)"

    def region(pattern: str, text: str) -> str:
        hit = f"length(regexp_extract({text},{lit(pattern)}))"
        return f"(case when {hit} > 0 then {hit} else length({text}) end)"

    def match(text: str, pattern: str) -> str:
        return f"regexp_matches({text},{lit(pattern)})"

    def suf(name: str, prev: str, suffixes) -> str:
        return f"{name} as (select word,w,r1,r2,go,regexp_extract(w,{lit(_suffixes(suffixes))},1) suf from {prev})"

    def step(name: str, prev: str, value: str, keep: str = "word,r1,r2,go") -> str:
        return f"{name} as (select {keep},case when go then {value} else w end w from {prev})"

    special = " ".join(f"when {lit(a)} then {lit(b)}" for a, b in S.SPECIAL_WORDS.items())
    done = ",".join(lit(w) for w in S.DONE_AFTER_PLURAL)
    in_r1, in_r2 = "length(w) - length(suf) >= r1", "length(w) - length(suf) >= r2"
    short = match("w", S.SHORT_END)
    return f"""
s0 as (select word, length(word) > 2 and not {match('word', '[\\p{N}]')} go,
  regexp_replace(regexp_replace(word,'^y','Y'),'([aeiouy])y','\\1Y','g') w from (select distinct word from {source})),
s1 as (select *, {region(S.REGION_1, 'w')} r1 from s0),
s2 as (select *, r1 + {region(S.REGION_2, 'substr(w,r1+1)')} r2 from s1),
{step('s3', 's2', f'''case when {match("w", "sses$")} then left(w,length(w)-2)
  when {match("w", "(ied|ies)$")} then case when length(w) > 4 then left(w,length(w)-2) else {before} end
  when {match("w", "(us|ss)$")} then w when {match("w", "[aeiouy].+s$")} then {before} else w end''')},
s4 as (select word,w,r1,r2,go and w not in ({done}) go from s3),
{suf('s5', 's4', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))},
s6 as (select word,r1,r2,go, go and suf in ('ed','edly','ing','ingly') and {match(rest, '[aeiouy]')} cut,
  case when go and suf in ('eed','eedly') and {in_r1} then {rest} || 'ee'
  when go and suf in ('ed','edly','ing','ingly') and {match(rest, '[aeiouy]')} then {rest} else w end w from s5),
{step('s7', 's6', f'''case when not cut then w when {match("w", "(at|bl|iz)$")} then w || 'e'
  when {match("w", "(" + "|".join(S.DOUBLES) + ")$")} then {before} when r1 >= length(w) and {short} then w || 'e' else w end''')},
{step('s8', 's7', f'case when {match("w", "^.+[^aeiouy][yY]$")} then {before} || {lit("i")} else w end')},
{suf('s9', 's8', S.STEP_2)},
{step('s10', 's9', f'''case when suf = '' or not {in_r1} or (suf = 'ogi' and not {match(rest, "l$")})
  or (suf = 'li' and not {match(rest, "[cdeghkmnrt]$")}) then w else {rest} || {_swap(S.STEP_2)} end''')},
{suf('s11', 's10', S.STEP_3)},
{step('s12', 's11', f'''case when suf = '' or not {in_r1} or (suf = 'ative' and not {in_r2}) then w
  else {rest} || {_swap(S.STEP_3)} end''')},
{suf('s13', 's12', S.STEP_4)},
{step('s14', 's13', f'''case when suf = '' or not {in_r2} or (suf = 'ion' and not {match(rest, "[st]$")}) then w
  else {rest} end''')},
{step('s15', 's14', f'''case when {match("w", "e$")} and (length(w)-1 >= r2
  or (length(w)-1 >= r1 and not {match(before, S.SHORT_END)})) then {before}
  when {match("w", "ll$")} and length(w)-1 >= r2 then {before} else w end''')},
stems as (select word, case word {special} else replace(w,'Y','y') end stem from s15)
"""


STOPS = ",".join(lit(w) for w in STOP_WORDS)
POSTINGS = f"""{WORDS}, kept as (select * from tok where word not in ({STOPS})), {stem_ctes('kept')},
posting as (select link_id, stem term, count(*)::int tf, list(pos order by pos) positions
  from kept join stems using (word) group by link_id, stem)
"""


def search_sql(condition: str, wanted: list[str], tail: str) -> str:
    """Documents that meet ``condition`` over term frequencies ``tf['x']`` and positions ``pos['x']``."""
    relevance = " + ".join(f"coalesce(1 + ln(tf[{lit(t)}]),0)" for t in wanted)
    return f"""with {POSTINGS},
per_doc as (select link_id, map(list(term), list(tf)) tf, map(list(term), list(positions)) pos
  from posting group by link_id),
hit as (select d.*, round({relevance},6) relevance from doc d left join per_doc p using (link_id)
  where {condition}) {tail}"""


def phrase_sql(terms: list[tuple[str, int]]) -> str:
    (first, _), *others = terms
    all_others = " and ".join(f"list_contains(pos[{lit(t)}], p + {n})" for t, n in others)
    return f"coalesce(len(list_filter(pos[{lit(first)}], lambda p: {all_others})) > 0, false)"


def has(term: str) -> str:
    return f"tf[{lit(term)}] is not null"


def page_sql(offset: int = 0, order: str = "asc") -> str:
    return f"""select row_number() over (order by relevance {order}, pagerank desc nulls first, link_id)::int rank_pos,
  link_id, url, title, relevance, pagerank from hit
  order by relevance {order}, pagerank desc nulls first, link_id limit 10 offset {offset}"""


def _real(x: object) -> str:
    return f"({x})::real"


def ts_rank_sql(terms: list[str], near: bool) -> str:
    """PostgreSQL's ts_rank over ``pos``, in single precision; positions count from 1."""
    # Positions rise, so equal ones (the last) are neighbours: keep those that differ from the one before.
    at = {
        t: f"list_filter(list_transform(pos[{lit(t)}], lambda p: least(p + 1, 16383)), lambda p, i: i = 1 or p < 16383 or pos[{lit(t)}][i - 1] + 1 < 16383)[1:255]"
        for t in sorted(terms)
    }
    if near:
        order = sorted(terms)
        pairs = ", ".join(
            f"coalesce(flatten(list_transform({at[a]}, lambda x: list_transform({at[b]}, lambda y: abs(x - y)))), [])"
            for i, a in enumerate(order)
            for b in order[:i]
        )
        near_by = "(1::double / (1.005::double + 0.05::double * exp(d::double / 1.5::double - 2::double)))::real"
        pair = f"sqrt((0.1::real * 0.1::real * case when d > 100 then 1e-30::real else {near_by} end)::double)::real"
        scores = f"list_transform(list_filter(flatten([{pairs}]), lambda d: d > 0), lambda d: {pair})"
        step = "case when s < 0 then w else (1::double - (1::double - s::double) * (1::double - w::double))::real end"
        total = f"list_reduce({scores}, lambda s, w: {step}, (-1)::real)"
        return f"(case when {total} < 0 then 1e-20::real else {total} end)::double"
    total = _real(0)
    for t in sorted(terms):
        often = f"list_reduce(range(1, len({at[t]}) + 1), lambda s, j: (s::real + (0.1::real / (j * j)::real)::real)::real, 0::real)"
        one = f"(((0.1::real + {often})::real - 0.1::real)::real)::double / 1.64493406685::double"
        total = f"(case when {has(t)} then ({total}::double + {one})::real else {total} end)"
    return f"(({total})::double / {len(terms)})::real::double"


def ranked_sql(condition: str, terms: list[str], near: bool, tail: str) -> str:
    """As ``search_sql`` with the score of ``ts_rank``."""
    return f"""with {POSTINGS},
per_doc as (select link_id, map(list(term), list(tf)) tf, map(list(term), list(positions)) pos
  from posting where term in ({",".join(lit(t) for t in terms)}) group by link_id),
hit as (select d.*, {ts_rank_sql(terms, near)} relevance from doc d left join per_doc p using (link_id)
  where {condition}) {tail}"""


MATCH = (f"{has('tion')} and {has('thing')}", ["thing", "tion"])
OR_NOT = (
    f"({has('tion')} and not ({has('ble')})) or {phrase_sql([('ing', 0), ('thre', 1)])}"
    f" or ({has('thnd')} and not ({has('er')}))",
    ["ing", "thnd", "thre", "tion"],
)
PHRASE = (phrase_sql([("tion", 0), ("er", 2)]), ["er", "tion"])

# -- sentences ----------------------------------------------------------------------

BREAK = (
    "regexp_replace({x},'([\\p{{Ll}}\\p{{S}}\\p{{N}}\\s][.!?])([\\p{{P}}\\s\\p{{N}}\\p{{Lu}}])','\\1'||chr(1)||'\\2','g')"
)
BREAK_SYMBOL = "regexp_replace({x},'(?s)(\\p{{S}}[.!?])([^\\x01])','\\1'||chr(1)||'\\2','g')"


def sentence_ctes(source: str) -> str:
    marked = "left(content, length(content) - 1)"
    for template in (BREAK, BREAK, BREAK_SYMBOL):
        marked = template.format(x=marked)
    return f"""
split as (select link_id, list_filter(string_split({marked} || right(content,1), chr(1)), lambda s: s <> '') ss
  from {source}),
sentence as (select link_id, unnest(ss) as text, unnest(range(len(ss)))::int ordinal from split),
worded as (select *, list_filter(string_split_regex(text,'\\s+'), lambda w: w <> '') ws from sentence)
"""


def ratio(terms: list[str]) -> str:
    wanted = ",".join(lit(t) for t in terms)
    return f"round(len(list_filter(ws, lambda w: lower(w) in ({wanted})))::double / greatest(len(ws),1),9)"


def summary_ctes(source: str, terms: list[str], limit: int = 256) -> str:
    """CTEs that end in ``summary(link_id, summary)`` for documents with a matching sentence."""
    return f"""{sentence_ctes(source)},
scored as (select link_id, ordinal, text, {ratio(terms)} r from worded),
spent as (select *, {limit} - coalesce(sum(length(text)) over (partition by link_id order by r desc, ordinal
  rows between unbounded preceding and 1 preceding),0) room from scored where r > 0),
cut as (select link_id, ordinal, case when length(text) > room then left(text,room::int) || '...' else text end as text
  from spent where room > 0),
gap as (select *, ordinal - lag(ordinal) over (partition by link_id order by ordinal) step from cut),
summary as (select link_id, regexp_replace(string_agg(case when step <> 1 then '..' else '' end || text ||
  case when text like '%.' then '' else '.' end, '' order by ordinal),'^\\s+|\\s+$','','g') summary from gap group by link_id)
"""


# -- trade graph ----------------------------------------------------------------------

TRADE = """
vertex as (select 'c' || c_custkey id from customer union all select 's' || s_suppkey from supplier),
bought as (select 'c' || o_custkey c, 's' || l_suppkey s, l_returnflag f from orders join lineitem on o_orderkey = l_orderkey),
edge as (select c src, s dst from bought union select s, c from bought where f = 'R'),
degree as (select id, coalesce(k,0) out_degree from vertex left join
  (select src, count(*) k from edge where src <> dst group by src) on src = id)
"""


def rank_ctes(vertex: str, edge: str, last: str, damping: float = 0.85) -> str:
    """Recursive CTEs that end in ``r(step, id, score, sad)``; ``last`` says when to go on."""
    return f"""
n as (select count(*)::double n from {vertex}),
e2 as (select e.src, e.dst from {edge} e join {vertex} v on v.id = e.src where e.src <> e.dst),
o as (select src, count(*)::double k from e2 group by src),
r(step, id, score, sad) as (
  select 1, id, 1.0::double / n, 1.0::double from {vertex}, n
  union all
  select step, id, score, sum(abs(score - old)) over () from (
    select p.step + 1 step, p.id, {round(1 - damping, 9)} / n + {damping} * coalesce(m.s,0) + {damping} * coalesce(dd.s,0) score, p.score old
    from r p cross join n
    left join (select e2.dst, sum(r.score / o.k) s from r join e2 on r.id = e2.src
      join o on o.src = r.id group by e2.dst) m on m.dst = p.id
    cross join (select sum(r.score / n) s from r cross join n where r.id not in (select src from o)) dd
    where {last}) q)
"""


# The bound on steps only keeps a wrong oracle from running for ever.
CONVERGED = "p.sad >= 0.001 and p.step < 200"


def bounds_sql(parts: int) -> str:
    rows = ",".join(f"({i},{lit(lo)},{lit(hi)})" for i, (lo, hi) in enumerate(range_bounds(NIL_ID, MAX_ID, parts)))
    return f"bound(part, lo, hi) as (values {rows})"


def oracle_sql() -> dict[str, str]:
    low, high, before = lit(Q.LOW), lit(Q.HIGH), ts(D.SCAN_BEFORE)
    terms = Q.SUMMARY_TEXT.split()
    submitted = f"sub as (select url from pages union all select unnest({UNQUOTED}) from pages)"
    crawl_new = f"""{GRAPH},
 now_edge as (select src, dst, {AS_OF} t from found_edge group by src, dst),
 folded as (select {uuid("src || '>' || dst")} id, src, dst, greatest(e.update_at, n.t) update_at
   from edge e full join now_edge n using (src, dst))"""
    changed = POSTINGS.replace(DOC, DOC.replace("doc as (", "doc0 as (", 1).rstrip() + """,
doc as (select link_id, url, title, case when right(url,1) = '3' then 'changed things ' || content else content end as content,
  indexed_at, pagerank from doc0 where right(url,1) <> '7')
""")
    # m: the id that each url has, in the store or by being new.
    foreign = f"""{GRAPH}, m as (select url, id made, case when id >= '5' then {uuid("'store' || id")} else id end id from link)"""
    # More steps than the graph has links in a row: the last ones change nothing.
    steps = 12
    spread = ", ".join(
        f"m{i} as (select v.id, greatest(v.value, max(p.value)) as value from m{i - 1} v"
        f" left join edge e on e.dst = v.id left join m{i - 1} p on p.id = e.src group by v.id, v.value)"
        for i in range(1, steps + 1)
    )
    changed_postings = f"with {changed} select link_id, term, tf, array_to_string(positions,' ') positions from posting"
    # Values of vertices and edges by superstep: a step updates a vertex, then its edges.
    traded = f"""{TRADE}, v0 as (select id, substr(id,2)::bigint as value from vertex),
 w0 as (select src, dst, (substr(src,2)::bigint * 3 + substr(dst,2)::bigint) % 1000 weight from edge)"""
    for i in range(4):
        sums = f"left join (select dst, sum(weight)::bigint s from w{i} group by dst) on dst = id" if i else ""
        traded += f""", v{i + 1} as (select id, {'(value + coalesce(s, 0)) % 1009' if i else 'value'} as value from v{i} {sums}),
 w{i + 1} as (select src, dst, weight // 2 + value % 100 + {i} weight from w{i} join v{i + 1} on id = src)"""
    history = f"""with recursive {TRADE}, {rank_ctes('vertex', 'edge', CONVERGED)},
 step as (select step, max(sad) sad, coalesce(sum(score) filter (id not in (select src from o)), 0.0) / max(n.n) residual
   from r, n group by step union all select 0, 0.0, 0.0),
 metric as (select step superstep, 'active' as name, n as value from step, n union all select step, 'page_count', n from step, n
   union all select step, 'sad', sad from step union all select step, 'residual', residual from step)
 select superstep::int superstep, name, round(value,8) as value,
   round(value - lag(value,1,0.0::double) over (partition by name order by superstep),8) delta from metric"""
    upserted_links = f"""with {GRAPH}, again as (select url, {START} + to_hours((page_id * 7 % 300)::int) t from page
 union all select url || '~', fetched_at from page)
 select {uuid('url')} id, url, max(t) retrieved_at from
 (select url, retrieved_at t from link union all select * from again) group by url"""
    upserted_edges = f"""with {GRAPH}, ok as (select * from batch where src in (select id from link) and dst in (select id from link))
 select {uuid("src || '>' || dst")} id, src, dst, case when ok.src is null then update_at else {AS_OF} end update_at
 from edge full join ok using (src, dst)"""
    upserted_documents = f"""with {DOC} select link_id, url || '?v=2' url, case when length(title) >= 20 then 'v2 ' || title end title,
 null::varchar content, {AS_OF} indexed_at, pagerank from doc
 union all select {uuid("'new' || url")}, url, title, md5(content), indexed_at, pagerank from doc"""
    return {
        "extract_pages": f"with {PAGE} select link_id, url, title, content, array_to_string(found_urls,' ') found_urls, page_id from page",
        "submit_urls": f"""with {submitted} select {uuid('u')} id, u url, {NEVER} retrieved_at from
 (select distinct {norm('url')} u from sub where {web('url')})""",
        "submit_rejects": f"with {submitted} select url, count(*) n from sub where not {web('url')} group by url",
        "upsert_links": upserted_links,
        "merge_links": upserted_links,
        "upsert_edges": upserted_edges,
        "merge_edges": upserted_edges,
        "edge_rejects": f"""with {GRAPH} select src, dst from batch
 where src not in (select id from link) or dst not in (select id from link)""",
        "stale_edges": f"""with {GRAPH} select * from edge e where not exists
 (select 1 from cutoff c where c.src = e.src and e.update_at < c.cutoff)""",
        "cascade_edges": f"""with {GRAPH}, alive as (select id from link where retrieved_at > {NEVER}
 or url in (select {ROOT} from page))
 select * from edge e where exists (select 1 from alive where id = e.src) and exists (select 1 from alive where id = e.dst)""",
        "crawl_frontier": f"with {GRAPH} select * from link where retrieved_at < {ts(D.FRONTIER_AS_OF)} - interval 7 day",
        "link_scan": f"with {GRAPH} select * from link where id >= {low} and id < {high} and retrieved_at < {before}",
        "edge_scan": f"with {GRAPH} select * from edge where src >= {low} and src < {high} and update_at < {before}",
        "lookup_link": f"with {GRAPH} select * from link where id = (select min(id) from link)",
        "apply_crawl_links": f"""with {GRAPH}, seen as (select url, retrieved_at t from link union all
 select url, {AS_OF} from page union all select url, {NEVER} from flat)
 select {uuid('url')} id, url, max(t) retrieved_at from seen group by url""",
        "apply_crawl_edges": f"""with {crawl_new} select * from folded f where not exists
 (select 1 from page p where p.link_id = f.src and f.update_at < {AS_OF})""",
        "apply_crawl_documents": f"""with {GRAPH}, newest as (select link_id, url, title, content,
 row_number() over (partition by link_id order by title desc, content desc) k from page)
 select n.link_id, n.url, n.title, n.content, {AS_OF} indexed_at, o.pagerank
 from newest n join old_doc o using (link_id) where k = 1""",
        "apply_crawl_foreign_ids_links": f"""with {foreign}, seen as (select url, retrieved_at t from link where id >= '5'
 union all select url, {AS_OF} from page union all select url, {NEVER} from flat)
 select m.id, url, max(t) retrieved_at from seen join m using (url) group by m.id, url""",
        "apply_crawl_foreign_ids_edges": f"""with {foreign},
 old_edge as (select e.id, a.id src, b.id dst, update_at from edge e join m a on a.made = e.src join m b on b.made = e.dst
   where e.src >= '5' and e.dst >= '5'),
 now_edge as (select distinct a.id src, b.id dst, {AS_OF} t from found_edge f join m a on a.made = f.src join m b on b.made = f.dst),
 folded as (select coalesce(e.id, {uuid("src || '>' || dst")}) id, src, dst, greatest(e.update_at, n.t) update_at
   from old_edge e full join now_edge n using (src, dst))
 select * from folded f where not exists (select 1 from page p join m on m.url = p.url where m.id = f.src and f.update_at < {AS_OF})""",
        "apply_crawl_foreign_ids_documents": f"""with {foreign}, newest as (select link_id, url, title, content,
 row_number() over (partition by link_id order by title desc, content desc) k from page)
 select m.id link_id, n.url, n.title, n.content, {AS_OF} indexed_at, case when n.link_id >= '5' then o.pagerank else 0.0 end pagerank
 from newest n join old_doc o using (link_id) join m on m.made = n.link_id where k = 1""",
        "crawl_report": f"with {PAGE} select count(*) fetched, (select count(*) * 2 from flat)::bigint dispatched from page",
        "upsert_documents": upserted_documents,
        "merge_documents": upserted_documents,
        "find_document": f"with {DOC} select * from doc where link_id = {uuid(lit(f'doc{Q.LOOKUP_DOC}'))}",
        "update_rank": f"""with {DOC} select link_id, url, case when regexp_extract(url,'[0-9]+$')::bigint % 3 = 0 then pagerank
 else regexp_extract(url,'[0-9]+$')::bigint / 1000.0::double end pagerank from doc""",
        "index_json": f"""with {DOC} select link_id, '{{"ID":"' || link_id || '","URL":"' || url || '","PageScore":' ||
 case when pagerank > 0.5 then '0.5' when pagerank > 0 then '0.25' else 'null' end || '}}' as json
 from doc order by link_id limit 10 offset 5""",
        "match_all": f"""with {DOC} select *, (row_number() over (order by link_id))::int rank_pos
 from doc order by link_id limit 10 offset 20""",
        "stem_terms": f"with {WORDS}, {stem_ctes('tok')} select word, stem from stems",
        "build_postings": f"with {POSTINGS} select link_id, term, tf, array_to_string(positions,' ') positions from posting",
        "build_postings_plain": f"""with {WORDS} select link_id, word term, count(*)::int tf,
 array_to_string(list(pos order by pos),' ') positions from tok group by link_id, word""",
        "update_postings": changed_postings,
        "segment_postings": changed_postings,
        "merged_postings": changed_postings,
        "segment_search": ranked_sql(MATCH[0], ["thing", "tion"], True, page_sql()).replace(POSTINGS, changed),
        "search_all_pages": search_sql(*OR_NOT, page_sql().replace("limit 10", "")),
        "search_after": search_sql(*MATCH, page_sql(10)),
        "search_match": search_sql(*MATCH, page_sql()),
        "search_match_desc": search_sql(*MATCH, page_sql(order="desc")),
        "search_or_not": search_sql(*OR_NOT, page_sql()),
        "search_or_not_all": search_sql(*OR_NOT, "select link_id, relevance from hit"),
        "search_phrase": search_sql(*PHRASE, page_sql()),
        "search_phrase_all": search_sql(*PHRASE, "select link_id, relevance from hit"),
        "search_rank": ranked_sql(MATCH[0], ["thing", "tion"], True, page_sql()),
        "search_rank_desc": ranked_sql(MATCH[0], ["thing", "tion"], True, page_sql(order="desc")),
        "search_rank_phrase": ranked_sql(PHRASE[0], ["er", "tion"], True, page_sql()),
        "block_matches_all": search_sql(*OR_NOT, "select link_id, relevance from hit"),
        "block_phrase_all": search_sql(*PHRASE, "select link_id, relevance from hit"),
        "search_top": ranked_sql(MATCH[0], ["thing", "tion"], True, page_sql()),
        "search_top_or_desc": ranked_sql(OR_NOT[0], ["ble", "er", "ing", "thnd", "thre", "tion"], False, page_sql(order="desc")),
        "search_top_log": search_sql(*MATCH, page_sql()),
        "search_rank_all": ranked_sql(MATCH[0], ["thing", "tion"], True, "select link_id, relevance from hit"),
        "search_rank_or_all": ranked_sql(
            OR_NOT[0], ["ble", "er", "ing", "thnd", "thre", "tion"], False, "select link_id, relevance from hit"
        ),
        "search_page2": search_sql(*MATCH, page_sql(10)),
        "search_count": search_sql(*OR_NOT, "select count(*) total from hit"),
        "page_details": search_sql(
            *MATCH,
            f""", c as (select count(*) total, greatest(least(10, count(*) - 20),0) shown from hit)
 select 21::bigint from_pos, (20 + shown)::bigint to_pos, total, '/search?q={Q.MATCH_TEXT.replace(' ', '+')}&offset=10' prev_link,
 case when 20 + shown < total then '/search?q={Q.MATCH_TEXT.replace(' ', '+')}&offset=' || (20 + shown)::bigint else '' end next_link from c""",
        ),
        "search_results": search_sql(
            *PHRASE,
            f""", top as ({page_sql()}), shown as (select t.rank_pos, d.* from top t join doc d using (link_id)),
 {summary_ctes('shown', ['tion', 'the', 'er'])}
 select link_id, url, coalesce(nullif(title,''),url) title,
 {em(escape("coalesce(summary,'')"), ['tion', 'the', 'er'])} summary_html, rank_pos
 from shown left join summary using (link_id)""",
        ),
        "sentences": f"with {DOC}, {sentence_ctes('doc')} select link_id, ordinal, text from sentence",
        "match_ratio": f"""with {DOC}, {sentence_ctes('doc')} select link_id, ordinal, {ratio(terms)} match_ratio
 from worded where {ratio(terms)} > 0""",
        "match_summary": f"""with {DOC}, {summary_ctes('doc', terms)} select link_id, coalesce(summary,'') summary
 from doc left join summary using (link_id)""",
        "highlight": f"with {DOC} select link_id, {em(escape('content'), terms)} content_html from doc",
        "out_degree": f"with {TRADE} select id, out_degree from degree",
        "dead_ends": f"""with {TRADE} select left(id,1) kind, count(*) n, count(*) filter (out_degree = 0) dead,
 round(count(*) filter (out_degree = 0) / count(*)::double,9) mass from degree group by kind""",
        "unknown_dst": f"""with {TRADE}, known as (select id from vertex where id not in
 (select 'c' || c_custkey from customer where c_acctbal < 0))
 select src, dst from edge where src in (select id from known) and dst not in (select id from known)""",
        "pagerank_steps": f"""with recursive {TRADE}, {rank_ctes('vertex', 'edge', 'p.step < 4')}
 select id, round(score,9) score from r where step = 4""",
        "pagerank": f"""with recursive {TRADE}, {rank_ctes('vertex', 'edge', CONVERGED)}
 select id, round(score,9) score, step::int superstep from r where step = (select max(step) from r)""",
        "pagerank_resumed": f"""with recursive {TRADE}, {rank_ctes('vertex', 'edge', 'p.sad >= 1e-12 and p.step < 200', 0.5)}
 select id, round(score,7) score from r where step = (select max(step) from r)""",
        "pagerank_history": history,
        "pregel_max": f"""with {TRADE}, m0 as (select id, substr(id,2)::bigint as value from vertex), {spread}
 select id, value from m{steps}""",
        "rank_pass": f"""with recursive {GRAPH}, {rank_ctes('link', 'edge', CONVERGED)}
 select o.link_id, o.url, round(coalesce(f.score, o.pagerank),9) pagerank from old_doc o
 left join (select * from r where step = (select max(step) from r)) f on f.id = o.link_id""",
        "search_total_all": f"with {DOC} select count(*) total from doc",
        "sent_messages": f"""with {TRADE}, sent as (select 's' || (c_custkey % 50) dst, max(c_custkey)::bigint msg from customer group by 1)
 select id, coalesce(msg, 0)::bigint as value from vertex left join sent on dst = id""",
        "duplicate_vertices": f"""with {TRADE}, d as (select src, count(*) k from edge group by src)
 select id, greatest(substr(id,2)::bigint, 100 - substr(id,2)::bigint) as value, coalesce(k, 0) out_degree from vertex left join d on src = id""",
        "edge_values": f"with {traded} select src, dst, weight from w4",
        "edge_value_vertices": f"with {traded} select id, value::bigint as value from v4",
        "id_extents": f"with {GRAPH}, {bounds_sql(7)} select link.* from link join bound on part = 3 and id >= lo and id < hi where retrieved_at < {before}",
        "uuid_partitions": f"""with {GRAPH}, {bounds_sql(7)} select part, lo, hi, count(id) n from bound
 left join link on id >= lo and id < hi group by part, lo, hi""",
        "assign_partition": f"with {GRAPH}, {bounds_sql(5)} select id, part from link left join bound on id >= lo and id < hi",
        "stream_links": f"""with {PAGE}, seen as (select url, fetched_at t from page union all
 select {norm("(url || '~')")}, {NEVER} from pages where {web("(url || '~')")})
 select {uuid('url')} id, url, max(t) retrieved_at from seen group by url""",
        "stream_crawl_links": f"""with {GRAPH}, seen as (select url, {AS_OF} t from page union all select url, {NEVER} from flat)
 select {uuid('url')} id, url, max(t) retrieved_at from seen group by url""",
        "stream_crawl_documents": f"""with {GRAPH}, newest as (select link_id, url, title, content,
 row_number() over (partition by link_id order by title desc, content desc) k from page)
 select link_id, url, title, content, {AS_OF} indexed_at, 0.0::double pagerank from newest where k = 1""",
        "stream_submissions": f"""with {submitted}
 select distinct {norm('url')} url, true accepted, 1::bigint n from sub where {web('url')}
 union all select url, false, count(*) from sub where not {web('url')} group by url""",
        "stream_crawl": f"""with {GRAPH} select distinct {uuid("src || '>' || dst")} id, src, dst, {AS_OF} update_at from found_edge""",
    }
