"""Secrets in text by a trigram inverted index; DataFrame functions only.

From each rule's regular expression follows what trigrams a match must hold: a
query of clauses, all of which must be met, each by one of several sets of
trigrams.  The index has a posting (trigram, text) for every trigram that some
query names.  Joining postings with the queries and counting gives the texts that
meet a set, a clause, a rule; only these are searched with the rule's expression.
A rule without mandatory trigrams searches every text.

The expressions are parsed on the driver; no text leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as op  # the standard library's own parser of expressions
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a piece of an expression may expand to before it counts as unknown.
MOST_STRINGS, MOST_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, of which those with a
    ``group`` shorter than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        fold=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # A run of 32 or more is a run that has 32 or more, so the bound can be in the expression.
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Forms that services publish for their keys.
SERVICE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + SERVICE_RULES

Clause = list[frozenset[str]]


# -- trigram queries ----------------------------------------------------------


def _trigrams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _clause(strings: Iterable[str]) -> Clause | None:
    """Any of the strings must occur; None if one of them has no trigram."""
    sets = {_trigrams(s) for s in strings}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _class_members(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_CLASS:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return found if len(found) <= MOST_CLASS else None


def _walk(items: Iterable, clauses: list[Clause]) -> set[str] | None:
    """The strings a sequence can be, or None; what it must hold goes to ``clauses``."""
    strings: set[str] = {""}
    exact = True

    def cut() -> None:
        nonlocal strings, exact
        found = _clause(strings)
        if found:
            clauses.append(found)
        strings, exact = {""}, False

    def extend(tails: set[str]) -> None:
        nonlocal strings
        if len(strings) * len(tails) > MOST_STRINGS:
            cut()
        strings = {s + t for s in strings for t in tails}

    for kind, value in items:
        if kind is op.LITERAL:
            extend({chr(value)})
        elif kind is op.IN and (members := _class_members(value)):
            extend(members)
        elif kind is op.SUBPATTERN:
            inner = _walk(value[-1], clauses)
            extend(inner) if inner else cut()
        elif kind is op.BRANCH:
            branches: list[tuple[set[str] | None, list[Clause]]] = []
            for branch in value[1]:
                own: list[Clause] = []
                branches.append((_walk(branch, own), own))
            if all(s for s, _ in branches):
                extend(set().union(*(s for s, _ in branches)))
            else:
                cut()
                # One of the branches: a clause of one clause of each, if each has one.
                if all(own for _, own in branches):
                    clauses.append([s for _, own in branches for s in own[0]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner_items = value
            own = []
            inner = _walk(inner_items, own)
            if inner and high == 1 and low == 0:
                extend(inner | {""})
            elif inner and low == high and len(inner) == 1:
                extend({next(iter(inner)) * low})
            else:
                if low and inner and len(inner) == 1:
                    extend({next(iter(inner)) * low})
                if low:
                    clauses.extend(own)
                cut()
        elif kind is op.AT or kind is op.ASSERT or kind is op.ASSERT_NOT:
            continue
        else:
            cut()
    if exact:
        return strings
    cut()
    return None


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses, all of which a text with a match meets, over trigrams in lower case.

    No clause means that a match need not hold any certain trigram.
    """
    clauses: list[Clause] = []
    strings = _walk(_parser.parse(pattern), clauses)
    if strings and (found := _clause(strings)):
        clauses.append(found)
    return clauses


# -- index, candidates, spans -------------------------------------------------


def build_index(texts: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """Postings (trigram, key) of ``texts`` (key, text), letters in lower case."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[int, list[Clause]]) -> DataFrame:
    """(key, rules): bit r is set if the text meets the query of rule r.

    The table of queries is as long as the rules.
    """
    wanted = [
        (t, r, c, s, len(trigrams))
        for r, clauses in queries.items()
        for c, clause in enumerate(clauses)
        for s, trigrams in enumerate(clause)
        for t in sorted(trigrams)
    ]
    spark = postings.sparkSession
    table = spark.createDataFrame(wanted, "trigram string, rule int, clause int, part int, size int")
    clauses = spark.createDataFrame([(r, len(c)) for r, c in queries.items()], "rule int, n_clauses int")
    parts = (
        postings.join(F.broadcast(table), "trigram")
        .groupBy("key", "rule", "clause", "part", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= size")
    )
    met = parts.groupBy("key", "rule").agg(F.size(F.collect_set("clause")).alias("met"))
    rules = met.join(F.broadcast(clauses), "rule").where("met = n_clauses")
    return rules.groupBy("key").agg(F.expr("bit_or(shiftleft(1L, rule))").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of a rule's matches, in code points.

    Between the matches lie the pieces that a split at the same expression gives,
    so the lengths of both add up to the positions.
    """
    regex = F.lit(rule.regex)
    pieces = F.split(text, rule.regex, -1)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    judged = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matches
    joined = F.arrays_zip(
        F.transform(matches, F.length).alias("m"),
        F.transform(judged, F.length).alias("g"),
        F.transform(pieces, F.length).alias("p"),
    )
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["m"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"),
            F.when(x["g"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    found = F.aggregate(joined, first, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, regex), found).otherwise(empty)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: spans are (start, ord, kind, end), by start and
    then by the order of the rules; ends are exclusive and count code points.

    Null texts are empty.  Rows are told apart by a hash of id and text; should two
    texts share it, both are searched, so equal hashes lose and add nothing.
    """
    queries = {r: q for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("key", F.xxhash64("doc_id", "text"))
    named = {t for q in queries.values() for clause in q for s in clause for t in s}
    if named:
        found = candidates(build_index(given.select("key", "text"), named), queries)
        given = given.join(found, "key", "left")
    else:
        given = given.withColumn("rules", F.lit(0).cast("long"))
    bits = F.coalesce("rules", F.lit(0).cast("long"))
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    each = [
        F.when(bits.bitwiseAND(F.lit(1 << r).cast("long")) != 0, _spans(F.col("text"), rule, r)).otherwise(empty)
        if r in queries
        else _spans(F.col("text"), rule, r)
        for r, rule in enumerate(rules)
    ]
    return given.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(one, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def duckdb_spans(rule: Rule, order: int) -> str:
    """The same spans as SQL for the checks: a list of structs over ``t``."""
    regex = rule.regex.replace("'", "''")
    matches = f"regexp_extract_all(t, '{regex}', 0)"
    judged = f"regexp_extract_all(t, '{regex}', {rule.group})"
    pieces = f"string_split_regex(t, '{regex}')"
    before = f"(list_sum(list_transform(({pieces})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(({matches})[1:i - 1], lambda x: length(x))), 0))"
    return (
        f"list_transform(list_filter(range(1, len({matches}) + 1), lambda i: length(({judged})[i]) >= {rule.least}), "
        f"lambda i: {{'s': {before}::bigint, 'o': {order}, 'k': '{rule.kind}', 'e': ({before} + length(({matches})[i]))::bigint}})"
    )


