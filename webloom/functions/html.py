"""Title, text and link targets of a fetched page.

A page is cut into tokens from left to right, as the tokenizer of a browser does it: a
comment, a whole element of raw text, a tag with its quoted values, or a stretch of
text.  What looks like a tag inside a comment, a script or a quoted value is thus never
one.  Title, text and links are then picked from the tokens.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import let

# A quote matters only after the sign of an attribute's value; an open one ends with the page.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"?+|'[^']*+'?+)?+)*+"""
RAW_TEXT, SHOWN_RAW_TEXT = ("script", "style"), ("title", "textarea")
TOKEN = "(?is)" + "|".join(
    [
        r"<!--(?:-?>|.*?(?:--!?>|\z))",
        *(rf"<{name}(?=[\s/>]){ATTRIBUTES}(?:>.*?(?:</{name}(?=[\s/>])[^>]*+>?+|\z)|\z)" for name in RAW_TEXT + SHOWN_RAW_TEXT),
        rf"</?[a-z][^\s/>]*+{ATTRIBUTES}>?+",
        "<[!?/][^>]*+>?+",
        "[^<]++",
        "<",
    ]
)
IN_SHOWN = rf"(?is)^<(?:title|textarea){ATTRIBUTES}>?|</(?:title|textarea)(?=[\s/>])[^>]*+>?\z"
# Attributes before the href, each with its value, so that none is taken from inside another.
HREF = r"""(?is)^<a(?:[\s/]+(?!href[\s=])[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)*[\s/]+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""

#: References that pages are full of; the others are looked up in a list of all of them.
COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7", "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "rsquo": "\u2019"}

#: All named references that end in a semicolon, from the standard library, as one literal.
NAMED = json.dumps({name: char for name, char in html5.items() if name.endswith(";")})


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded, once and from left to right.

    Pieces of the text between references are put together with what each
    reference stands for; an unknown name or number stays as written.
    """
    pattern = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names, common = F.from_json(F.lit(NAMED), "map<string,string>"), F.create_map(*[F.lit(x) for pair in COMMON.items() for x in pair])

    def char_of(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^#([0-9]+)$", 1)
        hexed = F.regexp_extract(reference, "^#[xX]([0-9A-Fa-f]+)$", 1)
        number = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
        written = F.concat(F.lit("&"), reference, F.lit(";"))
        numeric = F.when(valid, F.decode(utf32, "UTF-32")).otherwise(written)
        named = F.coalesce(common[reference], names[F.concat(reference, F.lit(";"))], written)
        return let(F.when(reference.startswith("#"), numeric).otherwise(named), lambda c: F.when(c == "\u00a0", " ").otherwise(c))

    def decode(raw: Column) -> Column:
        pieces = F.split(raw, pattern, -1)
        chars = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), char_of)
        whole = F.zip_with(pieces, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.when(raw.contains("&"), F.array_join(whole, "")).otherwise(raw)

    return let(text, decode)


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def page_fields(html: Column) -> Column:
    """A struct of the ``title``, the text (``content``) and the ``hrefs`` of a page.

    The title is that of the first title element, empty without one.  The text is all
    that is outside of tags, comments, scripts and styles.  The hrefs are the targets of
    all anchors in page order, quotes removed.
    """

    def inner(token: Column) -> Column:
        return F.regexp_replace(token, IN_SHOWN, "")

    def shown(token: Column) -> Column:
        raw = F.when(token.rlike("(?is)^<(title|textarea)[\\s/>]"), F.concat(F.lit(" "), inner(token), F.lit(" ")))
        return F.when(~token.startswith("<") | (token == "<"), token).otherwise(F.coalesce(raw, F.lit(" ")))

    def fields(tokens: Column) -> Column:
        titles = F.filter(tokens, lambda t: t.rlike("(?is)^<title[\\s/>]"))
        anchors = F.filter(tokens, lambda t: t.rlike("(?is)^<a[\\s/].*>\\z"))
        targets = F.filter(F.transform(anchors, lambda t: F.regexp_extract(t, HREF, 1)), lambda h: h != "")
        return F.struct(
            squeeze(decode_entities(F.coalesce(inner(F.get(titles, F.lit(0))), F.lit("")))).alias("title"),
            squeeze(decode_entities(F.array_join(F.transform(tokens, shown), ""))).alias("content"),
            F.transform(targets, lambda h: decode_entities(F.regexp_replace(h, """^["']|["']$""", ""))).alias("hrefs"),
        )

    found = let(F.regexp_extract_all(html, F.lit(TOKEN), 0), fields)
    return F.when(html.isNotNull(), found)


def page_hrefs(html: Column) -> Column:
    """The link targets alone."""
    return page_fields(html)["hrefs"]
