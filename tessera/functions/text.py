"""Text classification and normalisation as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import contains_any, first_rule

#: Fixed value: what titles lose before they are compared.
TITLE_NOISE = "[\\s\uff0c,\u3002.\uff01!\uff1f?\uff1a:\uff1b;\u3001\"'\uff08\uff09()\u300a\u300b\u3010\u3011\\[\\]{}\u2026\u2014\\-\u2013\u00b7\u30fb]+"
# Signs of pages that block readers, in the order in which they count.
BLOCK_SIGNS = [
    ("redirect", ["baidu.com", "百度一下"]),
    ("captcha", ["验证码", "captcha", "请证明", "人机验证"]),
    ("blocked_pattern", ["Just a moment", "cf-browser-verify", "_cf_chl_opt"]),
    ("blocked_pattern", ["请求过于频繁", "rate limit", "访问过于频繁"]),
]
STATUS_SIGNS = [("completed", ["完结", "完結", "completed"]), ("hiatus", ["停更", "休刊"])]
#: The other sources' own signs, by containment or by equality.
SHORT_STATUS_SIGNS = [("completed", ["完结", "完結"]), ("hiatus", ["停更"])]
STATUS_VALUES = {"completed": "completed", "完结": "completed"}
# Headers that a source may set, and those sent where it doesn't.
HEADER_KEYS = ["user-agent", "accept", "accept-language", "referer", "cookie"]
DEFAULT_HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "zh-CN,zh;q=0.9,en;q=0.8",
}
ERROR_SIGNS = [("DNS_FAILED", ["ENOTFOUND", "getaddrinfo"]), ("CONNECTION_REFUSED", ["ECONNREFUSED"]), ("TLS_FAILED", ["CERT_", "UNABLE_TO_VERIFY_LEAF_SIGNATURE", "SSL", "TLS"])]


def normalize_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), TITLE_NOISE, "")


def block_pattern(c: Column) -> Column:
    """Which kind of block page a body is; null for ordinary pages."""
    return first_rule(None, *[(contains_any(c, *signs), kind) for kind, signs in BLOCK_SIGNS])


def status_of(c: Column, signs: list = STATUS_SIGNS) -> Column:
    return first_rule("ongoing", *[(contains_any(c, *s), kind) for kind, s in signs])


def status_value(c: Column) -> Column:
    return first_rule("ongoing", *[(c == v, kind) for v, kind in STATUS_VALUES.items()])


def error_class(c: Column) -> Column:
    return first_rule("FETCH_FAILED", *[(contains_any(c, *s), kind) for kind, s in ERROR_SIGNS])


def http_class(code: Column) -> Column:
    """An error class for a status code; null if it is no error."""
    return first_rule(None, (code == 403, "HTTP_403"), (code == 404, "HTTP_404"), (code == 429, "HTTP_429"), (code >= 500, "HTTP_5XX"), (code >= 400, "HTTP_OTHER"))


def body_gate(content_type: Column, body: Column) -> Column:
    kind = F.coalesce(content_type, F.lit("text/html"))
    allowed = contains_any(kind, "text/html", "application/json", "text/plain")
    return first_rule("OK", (~allowed, "INVALID_CONTENT_TYPE"), (body.isNull() | (F.length(body) < 100), "EMPTY_HTML"))


def header_value(c: Column) -> Column:
    """A header value without line ends and characters outside ASCII; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"[\r\n]|[^\x00-\x7F]", ""), r"^\s+|\s+$", ""), F.lit(""))


def tags_of(c: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda t: F.trim(t)), lambda t: t != "")


def merged_headers(extra: Column) -> Column:
    """The default headers with those of `extra` that are allowed and not blank; a key takes a default's place only if it is spelled
    like it, else both stand."""
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULT_HEADERS.items() for x in kv])
    allowed = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(k)).isin(HEADER_KEYS))
    own = F.map_filter(F.transform_values(allowed, lambda k, v: header_value(v)), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
