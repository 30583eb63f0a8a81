"""URL and id columns: P6, P7, F16, F17, F22, F23."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import let

UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Optional user, then a name or an address in brackets, then an optional port.
AUTHORITY = r"([^/?#@]*@)?([^/?#@:\[\]]*|\[[0-9A-Fa-f:.]+(%25[^\]/?#]+)?\])(:[0-9]*)?"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def uuid_of(key: Column) -> Column:
    """F16: a repeatable id, the md5 of ``key`` in UUID form.

    A random id would change whenever a lost task is run again.
    """
    return F.regexp_replace(F.md5(key), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def parse_uuid(text: Column) -> Column:
    """canonical lower-case id, NULL when ``text`` is not a UUID."""
    low = F.lower(text)
    return F.when(low.rlike(UUID_PATTERN), low)


def is_web_url(url: Column) -> Column:
    """The scheme is http or https and the text parses as a URL.

    Control characters, a broken percent escape before the query, white space
    in the host, a port that is no number and brackets that do not enclose an
    address make a URL unparsable.  NULL counts as not accepted.
    """
    return F.coalesce(
        url.rlike("^[Hh][Tt][Tt][Pp][Ss]?:")
        & (~url.rlike("^[^:]*://") | url.rlike(f"^[^:]*://{AUTHORITY}([/?#]|$)"))
        & ~url.rlike("[\\x00-\\x1f\\x7f]")
        & ~url.rlike("^[^?#]*%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)")
        & ~url.rlike("^[^:]*://[^/?#]* "),
        F.lit(False),
    )


def normalise_url(url: Column) -> Column:
    """No fragment (nor a bare trailing ``#``), scheme in lower case."""

    def lower_scheme(bare: Column) -> Column:
        return let(
            F.regexp_extract(bare, SCHEME, 0),
            lambda scheme: F.concat(F.lower(scheme), F.substr(bare, F.length(scheme) + 1)),
        )

    return let(F.regexp_replace(url, "(?s)#.*$", ""), lower_scheme)


def base_parts(base: Column) -> Column:
    """What resolving needs of a page's url, so that it is taken apart once a page."""

    def parts(page: Column) -> Column:
        origin = F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
        folder = F.regexp_extract(F.substr(page, F.length(origin) + 1), "^/.*/|^/", 0)
        return F.struct(
            base.alias("url"),
            page.alias("page"),
            F.lower(F.regexp_extract(page, SCHEME, 0)).alias("scheme"),
            origin.alias("origin"),
            F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
        )

    return let(F.regexp_replace(base, "(?s)[?#].*$", ""), parts)


def remove_dots(url: Column) -> Column:
    """``.`` and ``..`` segments of the path worked off (RFC 3986 5.2.4); a ``..`` at
    the root is dropped.  Scheme, host and query stay."""

    def step(kept: Column, segment: Column) -> Column:
        popped = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", popped).when(segment == ".", kept).otherwise(F.array_append(kept, segment))

    def worked(u: Column) -> Column:
        origin = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
        path = F.regexp_extract(F.substr(u, F.length(origin) + 1), "^[^?#]*", 0)
        rest = F.substr(u, F.length(origin) + F.length(path) + 1)
        segments = F.split(F.substr(path, F.lit(2)), "/")
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        # A path that ends in a dot segment names a folder.
        folder = F.when(path.rlike("/[.]{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), folder, rest)

    return let(url, lambda u: F.when(u.rlike("^[^?#]*/[.]{1,2}([/?#]|$)"), worked(u)).otherwise(u))


def resolve_from(href: Column, base: Column) -> Column:
    """F23 for a page given by its ``base_parts``."""

    def absolute(h: Column) -> Column:
        return (
            F.when(h.startswith("//"), F.concat(base["scheme"], h))
            .when(h.startswith("/"), F.concat(base["origin"], h))
            .when((h == "") | h.startswith("#"), base["url"])
            .when(h.startswith("?"), F.concat(base["page"], h))
            .when(h.rlike(SCHEME), h)
            .otherwise(F.concat(base["origin"], base["folder"], h))
        )

    return remove_dots(normalise_url(let(F.trim(href), absolute)))


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as found on the page ``base``, made absolute and normalised."""
    return let(base_parts(base), lambda parts: resolve_from(href, parts))


def page_link(endpoint: str, query: Column, offset: Column) -> Column:
    """link to a result page; a zero or negative offset is left out."""
    base = F.concat(F.lit(f"{endpoint}?q="), F.url_encode(query))
    return F.when(offset > 0, F.concat(base, F.lit("&offset="), offset.cast("string"))).otherwise(base)
