"""Text columns: search text, tokens, sentences, summaries, highlighting.

Covers F1-F10, A16, P12, W1-W3, T5, T6 and X7.  All of it works inside one row
with built-in functions, so none of it shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.schemas import MAX_SUMMARY_LENGTH

TOKEN = r"[\p{L}\p{N}]+"

# A sentence ends after . ! or ? when a lower-case letter, symbol, number or
# space stands before the mark and a punctuation mark, space, number or capital
# (anything at all, if the character before the mark is a symbol) after it, and
# at least one more character follows.
SENTENCE_BREAK = (
    r"(?<=[\p{Ll}\p{S}\p{N}\p{IsWhite_Space}][.!?])(?=[\p{P}\p{IsWhite_Space}\p{N}\p{Lu}](?s:.))"
    r"|(?<=\p{S}[.!?])(?=(?s:..))"
)

# -- fixed values: the stop words of PostgreSQL's "english" configuration -----
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now
    """.split()
)
# ---------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda Spark does not share repeated sub-expressions, so a value
    used twice there is bound to a variable first: it is the start value of an
    aggregate over no elements, whose final step is ``body``.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def search_text(title: Column, content: Column) -> Column:
    """what the full-text index covers; the url is not part of it."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def sentences(content: Column) -> Column:
    """the sentences of a text; leading blanks stay with their sentence."""
    return F.filter(F.split(content, SENTENCE_BREAK), lambda s: s != "")


def words(sentence: Column) -> Column:
    """white-space separated words."""
    return F.filter(F.split(sentence, r"\p{IsWhite_Space}+"), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    """words of the search text after outer double quotes are trimmed."""
    return query.strip('"').split()


def match_ratio(sentence: Column, terms: list[str]) -> Column:
    """Share of the words that equal a term, ignoring case."""
    wanted = sorted({t.lower() for t in terms})
    hit = (lambda w: F.lower(w).isin(wanted)) if wanted else (lambda w: F.lit(False))
    return let(words(sentence), lambda ws: F.size(F.filter(ws, hit)) / F.greatest(F.size(ws), F.lit(1)))


def summary_snippets(content: Column, terms: list[str], max_length: int = MAX_SUMMARY_LENGTH) -> Column:
    """The sentences picked for a summary, in text order.

    Best ratio first, ties by position, until ``max_length`` characters are
    spent; the sentence that does not fit is cut and ends the choice.  At most
    ``max_length`` sentences are ever held, as each costs a character or more.
    """
    wanted = sorted({t.lower() for t in terms})
    numbered = F.transform(
        sentences(content), lambda s, i: F.struct(i.alias("ordinal"), s.alias("text"))
    )

    def may_match(s: Column) -> Column:
        # Most sentences hold no term at all; splitting them into words is dear.
        low = F.lower(s["text"])
        hit = F.lit(False)
        for term in wanted:
            hit = hit | low.contains(term)
        return hit

    # Rounding makes ratios that are equal as fractions equal as doubles too.
    scored = F.filter(
        F.transform(
            F.filter(numbered, may_match),
            lambda s: F.struct(
                (-F.round(match_ratio(s["text"], terms), 9)).alias("neg_ratio"),
                s["ordinal"].alias("ordinal"),
                s["text"].alias("text"),
            ),
        ),
        lambda s: s["neg_ratio"] < 0,
    )
    picked = "array<struct<ordinal:int,text:string>>"

    def take(state: Column, s: Column) -> Column:
        left = state["left"]
        text = F.when(
            F.length(s["text"]) > left, F.concat(F.substr(s["text"], F.lit(1), left), F.lit("..."))
        ).otherwise(s["text"])
        kept = F.array(F.struct(s["ordinal"].alias("ordinal"), text.alias("text")))
        return F.when(
            left > 0,
            F.struct(
                (left - F.length(text)).alias("left"), F.concat(state["picked"], kept).alias("picked")
            ),
        ).otherwise(state)

    start = F.struct(F.lit(max_length).alias("left"), F.array().cast(picked).alias("picked"))
    chosen = F.aggregate(F.array_sort(scored), start, take, lambda state: state["picked"])
    return F.array_sort(chosen)


def join_snippets(snippets: Column) -> Column:
    """One text; ``..`` marks a gap, each snippet ends with a full stop."""

    def joined(all_snippets: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            # get() yields NULL before the first snippet, so no gap is seen there.
            gap = s["ordinal"] - F.get(all_snippets, i - 1)["ordinal"] != 1
            return F.concat(
                F.when(gap, F.lit("..")).otherwise(F.lit("")),
                s["text"],
                F.when(s["text"].endswith("."), F.lit("")).otherwise(F.lit(".")),
            )

        return F.array_join(F.transform(all_snippets, piece), "")

    return F.regexp_replace(
        let(snippets, joined), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""
    )


def match_summary(content: Column, query: str, max_length: int = MAX_SUMMARY_LENGTH) -> Column:
    """Summary of ``content`` made of the sentences that match ``query``."""
    if max_length <= 0:
        max_length = MAX_SUMMARY_LENGTH
    return join_snippets(summary_snippets(F.coalesce(content, F.lit("")), query_terms(query), max_length))


def html_escape(text: Column) -> Column:
    """``&`` first, so that the other entities are not escaped again."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, query: str) -> Column:
    """F8: wrap each term in ``<em>``; any case, parts of words too, term by term."""
    for term in query_terms(query):
        literal = re.sub(r"([^\w\s])", r"\\\1", term)
        text = F.regexp_replace(text, f"(?iu){literal}", "<em>$0</em>")
    return text


def shown_title(title: Column, url: Column) -> Column:
    """P10: the url stands in for an empty title."""
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(url)


def is_phrase(text: str) -> bool:
    """a search text that starts and ends with a double quote."""
    return text.startswith('"') and text.endswith('"')
