"""Names and labels as column expressions; ids that need Unicode folding are one Arrow UDF each."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate, pairwise
from string import ascii_letters, digits

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Lengths of ids, participants and labels, and what label characters become.
MAX_ID, MAX_PARTICIPANT, MAX_LABEL = 32, 24, 80
SWAPS = ('";|\\<>%', "' //‹›％")
_SOURCE_EXT = re.compile(r"\.(py|js|jsx|ts|tsx|c|cc|cpp|h|hpp|go|rs|java)$", re.I)
_ALNUM = {*ascii_letters, *digits}
_SPACES = {i: " " for i in range(128) if chr(i) not in _ALNUM}


def stable_id(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by colons."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ":")


def topic(name: Column, ns: Column) -> Column:
    """Absolute and private names stay, others go under the namespace; empty stays empty."""
    inner = F.regexp_replace(ns, "^/+|/+$", "")
    return F.when((name == "") | name.startswith("/") | name.startswith("~"), name).when(inner == "", F.concat(F.lit("/"), name)).otherwise(F.concat(F.lit("/"), inner, F.lit("/"), name))


def remote(url: Column) -> Column:
    """A remote's URL without credentials."""
    return F.regexp_replace(url, r"(?<=://)[^/@\s]+@", "")


def label(x: Column, fallback: str = "unnamed", cap: int = MAX_LABEL) -> Column:
    """Entities go, characters with a meaning in diagrams are swapped, white space is one space; longer ones end in three dots."""
    y = F.translate(F.regexp_replace(x, "[#&][A-Za-z0-9]+;", ""), *SWAPS)
    y = F.trim(F.regexp_replace(y, r"\s+", " "))
    y = F.when(F.length(y) > cap, F.concat(F.rtrim(F.substring(y, 1, cap - 3)), F.lit("..."))).otherwise(y)
    return F.coalesce(F.nullif(y, F.lit("")), F.lit(fallback))


def message(x: Column) -> Column:
    """Text of a message: no number signs, a colon becomes a hyphen after a space."""
    return F.trim(F.regexp_replace(F.replace(F.replace(x, F.lit("#"), F.lit("")), F.lit(":"), F.lit(" -")), r"\s+", " "))


def comparable(x: Column) -> Column:
    """A label as verification compares it: no quotes, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[\"'`]", ""), r"\s+", " ")))


def dependency(x: Column) -> Column:
    """A requirement's bare name."""
    return F.replace(F.lower(F.regexp_extract(F.trim(x), r"^[^\s<>=!~;\[(]*", 0)), F.lit("_"), F.lit("-"))


def clearly_limited(x: Column) -> Column:
    """Whether the first 400 characters of a successful answer say plainly that a rate limit was hit."""
    return F.coalesce(F.substring(x, 1, 400).rlike(r"(?i)\b429\b|rate[- ]?limit(?:ed)?\b|too many requests"), F.lit(False))


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) of a character offset (from 0)."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def _ascii(x: str) -> str:
    return "".join(filter(str.isascii, unicodedata.normalize("NFKD", x)))


def _title(x: str) -> str:
    """Letters and digits of an ASCII text, each that follows none of them as a capital; all else as spaces."""
    return "".join(c.upper() if before not in _ALNUM else c if c in _ALNUM else " " for before, c in pairwise(f" {x}")).translate(_SPACES)


def camel(x: str, cap: int = MAX_ID) -> str:
    run = _title(_ascii(x)).replace(" ", "") or "n"
    run = run[0].lower() + run[1:] if run[0] not in digits else f"n{run}"
    mark = hashlib.sha1(x.encode()).hexdigest()[:6]
    return run if len(run) <= cap else f"{run[: cap - len(mark)]}{mark}"


def pascal(x: str, cap: int = MAX_PARTICIPANT) -> str:
    plain = _ascii(x).strip()
    words = _title(_SOURCE_EXT.sub("", plain)).split() or _title(plain).split()
    ends = [*accumulate(map(len, words))]  # as many words as the cap holds, one at least
    run = "".join(words[: max(1, bisect_right(ends, cap))])[:cap]
    return f"P{run}" if run[:1] in {*digits} else run


@F.pandas_udf(StringType())
def camel_id(x: pd.Series) -> pd.Series:
    """A camel-case ASCII id of at most 32 characters, longer ones with a hash at the end; null stays null."""
    return x.map(camel, na_action="ignore")


@F.pandas_udf(StringType())
def pascal_name(x: pd.Series) -> pd.Series:
    """A readable Pascal-case name of whole words, at most 24 characters; null stays null."""
    return x.map(pascal, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def allocated(bases: pd.Series, reserved: pd.Series) -> pd.Series:
    """Unique ids for an ordered array of names (one diagram's), whatever their case; reserved words get a suffix, repeats a number from 2."""

    def each(names, words):
        used, out = {w.lower() for w in words}, []
        for base in names:
            base = f"{base}Node" if base.lower() in {w.lower() for w in words} else base
            n, name = 1, base
            while name.lower() in used:
                n += 1
                name = f"{base}{n}"
            used.add(name.lower())
            out.append(name)
        return out

    return pd.Series([each(n, w) for n, w in zip(bases, reserved)])


_QUOTED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S)


@F.pandas_udf(StringType())
def blanked(x: pd.Series) -> pd.Series:
    """C-like source with comments and the insides of quotes as blanks; offsets and line breaks stay."""

    def each(m):
        q = m.group()
        inner = re.sub(r"[^\n]", " ", q[1:-1] if q[0] in "\"'" and len(q) > 1 and q[-1] == q[0] else q[1:] if q[0] in "\"'" else q)
        return inner if q[0] == "/" else q[0] + inner + (q[-1] if len(q) > 1 and q[-1] == q[0] else "")

    return x.map(lambda s: _QUOTED.sub(each, s), na_action="ignore")
