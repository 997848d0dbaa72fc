"""URLs as expressions: hosts, resolution of links, templates, safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import encode_component, trimmed

# What templates call the keyword, first match counts; and hosts that must not be read.
PLACEHOLDERS = ["{{keyword}}", "{keyword}", "{{key}}", "{key}", "searchKey", "%s"]
PRIVATE_HOST = r"^(127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+|0\.0\.0\.0$|localhost$|\[::1\]$)"
ABSOLUTE = r"(?i)^https?://"


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1), F.lit("")))


def origin_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/]+)", 1), F.lit(""))


def clean_host(c: Column) -> Column:
    """Without a # note and slashes at the end."""
    return F.regexp_replace(F.split(c, "#")[0], "/+$", "")


def is_safe(url: Column) -> Column:
    """http or https, and neither a private address nor localhost."""
    host = host_of(url)
    return F.coalesce(F.trim(url).rlike(ABSOLUTE) & host.isNotNull() & ~host.rlike(PRIVATE_HOST), F.lit(False))


def resolve(link: Column, base: Column, repair: bool = False) -> Column:
    """An absolute URL for a link on a page of `base`. A bare relative link against a host without a path takes the place of
    the host, as in the rules this follows; repair=True keeps the host."""
    base = F.regexp_replace(base, "/+$", "")
    folder = F.regexp_extract(base, "^(.*/)", 1)
    if repair:
        folder = F.when(base.rlike(r"^https?://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(folder)
    return (
        F.when(F.coalesce(link, F.lit("")) == "", F.lit(""))
        .when(link.rlike(ABSOLUTE), link)
        .when(link.startswith("//"), F.concat(F.when(base.startswith("https"), F.lit("https:")).otherwise(F.lit("http:")), link))
        .when(link.startswith("/"), F.concat(F.coalesce(origin_of(base), base), link))
        .otherwise(F.concat(folder, link))
    )


def resolve_plain(link: Column, base: Column) -> Column:
    """The server's rules: // is always https, all else hangs on the host."""
    host = F.regexp_replace(base, "/$", "")
    return (
        F.when(F.coalesce(link, F.lit("")) == "", F.lit(""))
        .when(link.startswith("http"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .otherwise(F.concat(host, F.lit("/"), link))
    )


def apply_keyword(template: Column, keyword: Column) -> Column:
    """The template with its first kind of placeholder filled in, or else a query parameter `keyword`."""
    word = encode_component(keyword)
    joint = F.when(template.contains("?"), F.lit("&keyword=")).otherwise(F.lit("?keyword="))
    filled = reduce(
        lambda acc, p: F.when(template.contains(p), F.replace(template, F.lit(p), word)) if acc is None else acc.when(template.contains(p), F.replace(template, F.lit(p), word)),
        PLACEHOLDERS,
        None,
    )
    return filled.otherwise(F.concat(template, joint, word))


def full_url(template: Column, host: Column) -> Column:
    host = F.when(host.rlike(ABSOLUTE), host).otherwise(F.concat(F.lit("https://"), host))
    base = F.regexp_replace(host, "/+$", "")
    return F.when(template.rlike(ABSOLUTE), template).when(template.startswith("/"), F.concat(origin_of(base), template)).otherwise(F.concat(base, F.lit("/"), template))


def failover_hosts(host: Column) -> Column:
    """Hosts to try, in order: a cn. host also as www. and m."""
    rest = F.regexp_extract(host, r"^cn\.(.*)$", 1)
    return F.when(host.startswith("cn."), F.array(host, F.concat(F.lit("www."), rest), F.concat(F.lit("m."), rest))).otherwise(F.array(host))


def replace_first(c: Column, piece: str, new: Column) -> Column:
    """The text with the first occurrence of a fixed piece replaced."""
    at = F.instr(c, piece)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + len(piece), F.length(c)))).otherwise(c)


def keyword_url(template: Column, keyword: Column, host: Column) -> Column:
    """The first form of search URLs: {{keyword}} percent-encoded, {{keyword.raw}} as it is, relative paths on the host."""
    url = F.replace(F.replace(template, F.lit("{{keyword}}"), encode_component(keyword)), F.lit("{{keyword.raw}}"), keyword)
    base = F.regexp_replace(host, "/+$", "")
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(base, F.lit("/"), F.regexp_replace(url, "^/", "")))


def safe_search_url(template: Column, keyword: Column, host: Column) -> Column:
    """The search URL, or null if it mustn't be read."""
    url = full_url(apply_keyword(template, keyword), host)
    return F.when(is_safe(url), url)


def looks_like_url(c: Column) -> Column:
    return c.rlike(ABSOLUTE) | c.rlike("^/[^@]")


# The fields in which a source may keep its search URL, first match counts; the last may also be a selector.
URL_FIELDS = ["path", "searchUrl", "ruleSearchUrl", "url"]


def template_of(search: dict[str, Column], raw: dict[str, Column]) -> Column:
    """The first URL template among the fields of a source's search part and raw record, field by field; blank is missing."""
    found = []
    for field in URL_FIELDS:
        for place in (search, raw):
            if field in place:
                value = F.nullif(trimmed(place[field]), F.lit(""))
                found.append(F.when(looks_like_url(value), value) if field == "url" else value)
    return F.coalesce(*found)


def field_of(search: dict[str, Column], raw: dict[str, Column], names: list[str]) -> Column:
    """The first text that isn't blank among alias names; a name that the search part has hides the raw record's."""
    both = [F.coalesce(search.get(n, F.lit(None)), raw.get(n, F.lit(None))) for n in names]
    return F.coalesce(*[F.nullif(trimmed(b), F.lit("")) for b in both], F.lit(""))
