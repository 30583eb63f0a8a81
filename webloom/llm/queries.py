"""One query per corpus operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import collocations, dac, decontaminate, htmltext, imatch, licenses, linededup, packing, quality, runs, secrets, simhash, warc
from webloom.llm.common import table
from webloom.llm.license_templates import templates
from webloom.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def _sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    placed = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"], m["end"], m["license"])))
    spans = F.transform(placed, lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
        F.array_join(spans, ",").alias("spans"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = dac.write_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), tokenizer, end_id=2)
    return dac.read_tokens(manifest)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    spans, kinds = F.col("spans"), [r.kind for r in secrets.BASE_RULES]
    base = F.filter(spans, lambda s: s["ord"] < len(kinds))
    return found.select(
        "doc_id",
        *[secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on_rest(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_passages(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_repeated(docs, linededup.build(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc.round_trip(pages, fresh_path(spark, "archives"))
    return records.select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summarise(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    known = (op1_licenses, op2_token_files, op3_secrets, op4_packing, op5_quality, op6_fingerprints, op7_decontamination, op8_line_dedup, op9_simhash, op10_html_text, op11_warc, op12_collocations, op13_runs)
    return {f.__name__: f for f in known}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), item_words as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), windows as (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as gram
    from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
          from item_words where len(w) > 0)
), grams as (
    select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
          from words, (select distinct n from windows) where len(w) >= n)
), hits as (
    select doc_id, i, grams.n, item_id from grams join windows on grams.gram = windows.gram and grams.n = windows.n
), covered as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), items as (
    select doc_id, count(distinct item_id) as n_items,
           array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids
    from hits group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join covered using (doc_id) left join items using (doc_id)
"""

OP8_SQL = r"""
with lines as (
    select doc_id, line, i,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
          from documents)
), repeated as (
    select k, min(doc_id) as first_doc from lines where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), marked as (
    select doc_id, line, i, first_doc is not null and first_doc <> doc_id as dropped from lines left join repeated using (k)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""


OP11_SQL = """
with given as (select page_id, coalesce(html, '') as p from pages),
firsts as (select p, max(page_id) as first_id from given where strlen(p) >= 1000 group by p),
marked as (select page_id, given.p, coalesce(page_id <> first_id or page_id is null and first_id is not null, false) as again, first_id
           from given left join firsts on given.p = firsts.p)
select page_id, strlen(p)::bigint as payload_bytes, sha1(p) as payload_digest,
       case when again then 'revisit' else 'response' end as record_type, case when again then first_id end as refers_to
from marked
"""


OP12_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, w from (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces) where len(w) > 0
), totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
counts as (
    select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase, count(*) as n
    from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from worded, (values (1), (2), (3)) sizes(size) where len(w) >= size)
    group by all
), candidates as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from counts where size > 1 and n >= 10),
cuts as (
    select c.lang, c.phrase, c.size, c.a, k, l.n as l, r.n as r, (1000000::hugeint * c.a * c.a) // (l.n::hugeint * r.n) as score
    from (select *, unnest(range(1, size)) as k from candidates) c
    join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
    join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
    select lang, part, max(a) as most
    from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from candidates where size = 3)
    group by lang, part
), kept as (
    select lowest.* from lowest left join longer on longer.lang = lowest.lang and longer.part = lowest.phrase
    where most is null or 100 * most < 50 * a
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""


def _op3_sql() -> str:
    each = [secrets.duckdb_spans(rule, order) for order, rule in enumerate(secrets.RULES)]
    found = "list_sort(list_concat(list_concat(list_concat({}, {}), list_concat({}, {})), list_concat(list_concat({}, {}), list_concat({}, {}))))".format(*each)
    listed = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    base = listed.format("list_filter(f, lambda x: x.o < 3)")
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = '{r.kind}'))::bigint as n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents), found as (select doc_id, {found} as f from texts)
select doc_id, {counts}, sha256(coalesce({base}, '')) as base_sha256, coalesce({listed.format('f')}, '') as spans from found
"""


def _op1_sql() -> str:
    given = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates())
    words = r"regexp_extract_all(replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licence', 'license'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    starts = "length(array_to_string(p[1:i - 1], {m})) + case when i > 1 then {n} else 0 end"
    return f"""
with given(name, body) as (values {given}),
templates as (select distinct name, g from (select name, {grams} as g from (select name, {words.format('body')} as w from given)) where len(g) > 0),
texts as (select doc_id, coalesce(text, '') as t from documents),
parts as (
    select doc_id, [t] as p, 1 as i, 0 as a, t as u from texts
    union all select doc_id, p, i, {starts.format(m="chr(10) || chr(10)", n=2)}, p[i]
        from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(t, chr(10) || chr(10)) as p from texts))
    union all select doc_id, p, i, {starts.format(m="chr(10)", n=1)}, p[i]
        from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(t, chr(10)) as p from texts))
), units as (select distinct doc_id, a, a + length(u) as e, u from parts where u <> ''),
sets as (select doc_id, a, e, g from (select doc_id, a, e, {grams} as g from (select doc_id, a, e, {words.format('u')} as w from units)) where len(g) > 0),
scored as (
    select doc_id, a, e, name, 2 * len(list_intersect(sets.g, templates.g)) / (len(sets.g) + len(templates.g))::double as d
    from sets join templates on len(sets.g) between 0.66 * len(templates.g) and 1.51 * len(templates.g)
), best as (
    select doc_id, a, e, max(d) as d, min(name) filter (where d = m) as name
    from (select *, max(d) over (partition by doc_id, a, e) as m from scored) group by doc_id, a, e having max(d) >= 0.8
), found as (
    select doc_id, count(*) as n, array_to_string(list_sort(list(distinct name)), ',') as names, max(d) as d,
           string_agg(name || ':' || a || ':' || e, ',' order by a, e, name) as spans
    from best group by doc_id
)
select doc_id, coalesce(n, 0)::bigint as n_matches, coalesce(names, '') as licenses, coalesce(d, 0.0)::double as best_dice, coalesce(spans, '') as spans
from texts left join found using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": _op1_sql(), "op3_secrets": _op3_sql(), "op7_decontamination": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_warc": OP11_SQL, "op12_collocations": OP12_SQL}
