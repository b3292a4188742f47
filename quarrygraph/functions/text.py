"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(x: Column) -> Column:
    """Lower case, runs of other than letters and digits as one hyphen, trimmed; x where nothing is left."""
    y = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    y = F.regexp_replace(y, "^-|-$", "")
    return F.when(y == "", F.lit("x")).otherwise(y)


def route(url: Column) -> Column:
    """A route as both sides of a call write it: no query; {x}, <x>, :x and ${x} as {}; single slashes; a slash in front, none behind."""
    p = F.regexp_replace(url, r"\?.*$", "")
    p = F.regexp_replace(p, r"\{[^}]*\}|<[^>]*>|:\w+|\$\{[^}]*\}", "{}")
    p = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/"), "/$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def plain(html: Column) -> Column:
    """Text between tags: comments and tags go, white space runs become one space, ends are trimmed."""
    x = F.regexp_replace(html, "<!--[^>]*-->", " ")
    x = F.regexp_replace(x, "</?[a-zA-Z][^>]*>|<![^>]*>", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


#: Simple forms of e-mail addresses, long hexadecimal tokens and private IPv4 addresses, without looking around (functions/redaction.py has the exact ones).
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEX = r"[0-9a-fA-F]{32,}"
PRIVATE_IP = r"(10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3}|172\.(1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}|169\.254\.[0-9]{1,3}\.[0-9]{1,3})"

# Tags, pictographs and invisible characters that labels lose.
TAGS = "a abbr b big blockquote body br center code dd del details div dl dt em font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link mark meta nav object ol p pre q s samp script section small span strike strong style sub summary sup svg table tbody td textarea th thead title tr tt u ul var video audio button canvas embed math"
EMOJI = r"[\x{1f000}-\x{1faff}\x{1fc00}-\x{1fffd}\x{2600}-\x{27bf}\x{2300}-\x{23ff}\x{2b00}-\x{2bff}\x{2194}-\x{2199}\x{21a9}\x{21aa}\x{203c}\x{2049}\x{2122}\x{2139}\x{24c2}\x{a9}\x{ae}\x{25aa}\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}\x{3030}\x{303d}\x{3297}\x{3299}\x{fe00}-\x{fe0f}\x{200d}\x{20e3}\x{e0020}-\x{e007f}]"
CONTROLS = r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{2028}\x{2029}]"
INVISIBLE = r"[\x{200b}\x{200c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]"


def normalised(x: Column) -> Column:
    """One line of plain words: known tags, comments, controls and literal escapes become spaces; pictographs, invisible characters and backticks go."""
    x = F.regexp_replace(x, rf"(?is)<\s*/?\s*(?:{TAGS.replace(' ', '|')})\b[^<>]*>|<!--.*?-->|<!\[CDATA\[.*?\]\]>", " ")
    x = F.regexp_replace(F.regexp_replace(x, EMOJI, ""), INVISIBLE, "")
    x = F.regexp_replace(F.regexp_replace(x, CONTROLS, " "), r"\\[nrt]", " ")
    return F.trim(F.regexp_replace(F.translate(x, "`", ""), r"(?U)\s+", " "))


def redact(x: Column, pattern: str, name: str) -> Column:
    return F.regexp_replace(x, pattern, f"[{name}]")


def entropy(x: Column) -> Column:
    """Shannon entropy in bits over characters; empty is 0."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p)))


# Error classes in the order in which they are tried, and the phrases that alone tell a limit.
ERRORS = {
    "rate_limit": r"\b429\b|rate[- ]?limit|too many requests|\bquota\b|retry[- ]after|throttl",
    "auth": r"\b40[13]\b|unauthori[sz]ed|unauthenticated|not authenticated|authenticat|forbidden|invalid[_ ]token|token (?:has )?expired|access denied|log ?in required|permission denied|oauth",
    "network": r"\b50[234]\b|timed? ?out|timeout|econn|connection (?:refused|reset|closed|error)|network|disconnected|not connected|socket|unreachable|service unavailable|no such tool|tool (?:is )?(?:not available|unavailable)|mcp server|fetch failed",
    "not_found": r"\b404\b|not found|does not exist|no such (?:file|node)|unknown file",
    "invalid_request": r"\b400\b|\b422\b|invalid|syntax|parse error|could not parse|failed to parse|bad request|validation|unsupported|unexpected token|mermaid|lexical error",
}
LIMITED = r"\b429\b|rate[- ]?limit(?:ed)?\b|too many requests"
WAITS = [r"retry[- ]after[\"']?\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(milliseconds?|minutes?|seconds?|min|sec|ms|m|s)?", r"try again in\s*(\d+(?:\.\d+)?)\s*(milliseconds?|minutes?|seconds?|min|sec|ms|m|s)?"]


def error_class(x: Column) -> Column:
    """The first class whose words a message holds; unknown for others and for none."""
    classes = F.array(*[F.when(F.lower(x).rlike(p), F.lit(k)) for k, p in ERRORS.items()])
    return F.coalesce(F.try_element_at(F.array_compact(classes), F.lit(1)), F.lit("unknown"))


def retry_after(x: Column) -> Column:
    """Seconds that a message asks to wait, by the first of two phrasings; no unit is seconds; null without."""

    def said(pattern):
        n = F.nullif(F.regexp_extract(F.lower(x), pattern, 1), F.lit("")).cast("double")
        unit = F.regexp_extract(F.lower(x), pattern, 2)
        return F.when(unit.rlike("^(ms|milli)"), n / 1000).when(unit.startswith("m"), n * 60).otherwise(n)

    return F.coalesce(*map(said, WAITS))
