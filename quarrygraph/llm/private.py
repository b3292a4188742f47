"""Operator 2: personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Other tokens with digits are candidates. Four
labelers (patterns, a gazetteer, context words, shape) vote on every span or abstain; expectation-maximisation over the
counts of all vote patterns estimates how reliable each is, and a logistic span classifier learns the resulting
probabilities from the spans' features. Candidates that it accepts are added as kind "secret"; base spans stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import bounded_batches, chunks, cut, table

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs of digits are taken whole: a match can only begin where a run does, and scanning stays linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
_SEP = re.compile(r"[=:]")
_TRIM = ".,;:!?()[]{}<>\"'`"
#: Gazetteers: names of fields that hold secrets, how well-known keys begin, words that announce personal data, words that announce plain numbers.
FIELDS = frozenset("password passwd pwd secret token apikey api_key key ssn iban login passphrase passwort contraseña".split())
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
BEFORE = frozenset("call phone tel mail email contact card account password login id ssn token key".split())
PLAIN = frozenset("version page chapter section figure fig table year license by no article item part volume".split())
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}\Z|ASIA[0-9A-Z]{16}\Z|gh[po]_[A-Za-z0-9]{20,}\Z|[0-9a-f]{16,}\Z|\d{3}-\d{2}-\d{4}\Z|[A-Z]{2}\d{2}[A-Z0-9]{11,30}\Z")
_NUMBER = re.compile(r"v?[0-9]+(?:[.,:/%-][0-9]+)*%?\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern: before an @, the longest run of its characters; behind it the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start and then kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens with a digit that touch no base span: (start, end, field name before = or :)."""
    if not _DIGIT.search(text):
        return []
    out, taken, k = [], sorted((a, b) for a, b, _ in base), 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if any(x < b and y > a for x, y in taken[k : k + 4]):
            continue
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        name, sep = "", _SEP.search(text, a, b)
        if sep and sep.start() > a and sep.end() < b:
            name, a = text[a : sep.start()].lower(), sep.end()
        if b - a >= 6:
            out.append((a, b, name))
    return out


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def describe(text: str, a: int, b: int, name: str, base: bool) -> tuple[int, int]:
    """(votes, features): each labeler's vote in base 3 (0 abstains, 1 no, 2 yes), features as bits."""
    s, before = text[a:b], text[max(0, a - len(name) - 41) : max(0, a - len(name) - bool(name))].split()
    word = before[-1].strip(_TRIM).lower() if before else ""
    letters, digits = sum(map(str.isalpha, s)), sum(map(str.isdigit, s))
    h = entropy(s)
    number = bool(_NUMBER.match(s))
    votes = (
        2 if base or _SECRET.match(s) else 1 if number else 0,
        2 if name in FIELDS or s.startswith(STARTS) else 1 if name and number else 0,
        2 if word in BEFORE else 1 if word in PLAIN else 0,
        2 if letters >= 2 and digits >= 2 and h > 2.8 and len(s) >= 10 else 1 if number and digits < 8 else 0,
    )
    bits = (base, name in FIELDS, bool(name), s.startswith(STARTS), word in BEFORE, word in PLAIN, letters > 0, digits >= 6, digits >= 10, h > 2.8, h > 3.4, len(s) >= 10, len(s) >= 16, number)
    return sum(v * 3**i for i, v in enumerate(votes)), sum(bool(x) << i for i, x in enumerate(bits))


N_BITS = 14


def train(patterns: list[tuple[int, int, int]], rounds: int = 50) -> np.ndarray:
    """Weights of the span classifier (bias last) from (votes, features, count): EM over the votes, then logistic regression on its probabilities."""
    if not patterns:
        return np.append(np.zeros(N_BITS), -1.0)
    v = np.array([[p[0] // 3**i % 3 for i in range(4)] for p in patterns])
    x = np.array([[p[1] >> i & 1 for i in range(N_BITS)] + [1] for p in patterns], float)
    n = np.array([p[2] for p in patterns], float)
    yes = np.clip((v == 2).sum(1) / np.maximum((v > 0).sum(1), 1), 0.05, 0.95)
    yes[(v == 0).all(1)] = 0.2
    for _ in range(rounds):
        prior = np.clip((n * yes).sum() / n.sum(), 0.01, 0.99)
        score = np.full(len(n), math.log(prior / (1 - prior)))
        for k in range(4):  # abstaining says nothing; a labeler is better than chance by its design
            voted = v[:, k] > 0
            for c in (1, 2):
                on = v[:, k] == c
                p1 = ((n * yes)[on].sum() + (4 if c == 2 else 1)) / ((n * yes)[voted].sum() + 5)
                p0 = ((n * (1 - yes))[on].sum() + (1 if c == 2 else 4)) / ((n * (1 - yes))[voted].sum() + 5)
                score += on * math.log(p1 / p0)
        yes = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - yes)) + 0.5 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepts(w: np.ndarray, features: int) -> bool:
    return float(w[-1] + sum(w[i] for i in range(N_BITS) if features >> i & 1)) >= 0


_FOUND = "doc_id long, base array<string>, extra array<string>, extra_features array<int>, seen array<string>"


def find(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each document, and "votes:features" of all of them."""

    def run(batches):
        for batch, data, offs in chunks(batches):
            raw, out = data.tobytes(), []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                text = raw[a:b].decode("utf-8", "replace")
                base = base_spans(text)
                extra = candidates(text, base)
                f = [describe(text, x, y, name, False) for x, y, name in extra]
                g = [describe(text, x, y, "", True) for x, y, _ in base]
                out.append(([f"{k}:{x}:{y}" for x, y, k in base], [f"secret:{x}:{y}" for x, y, _ in extra], [q for _, q in f], [f"{p}:{q}" for p, q in f + g]))
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "base", "extra", "extra_features", "seen"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans "kind:start:end" of every whole text, base ones and those that the classifier adds.

    Null and empty texts have none; repeated rows each have theirs; null doc_id stays; an empty table gives no rows;
    other columns are not read. The vote patterns of all documents are counted; their number is bounded by the
    labelers' and features' values, and only the counts reach the driver.
    """
    found = cut(find(docs), "private")
    counts = found.select(F.explode("seen").alias("p")).groupBy("p").count().collect()
    w = train(sorted((*map(int, r.p.split(":")), r["count"]) for r in counts))
    values = sorted({int(r.p.split(":")[1]) for r in counts})
    good = [q for q in values if accepts(w, q)]
    pairs = F.arrays_zip(F.col("extra").alias("s"), F.col("extra_features").alias("f"))
    ok = F.array(*[F.lit(q) for q in good]) if good else F.array().cast("array<int>")
    return found.select("doc_id", "base", F.transform(F.filter(pairs, lambda x: F.array_contains(ok, x["f"])), lambda x: x["s"]).alias("added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(part(x, 2).cast("int").alias("a"), F.array_position(F.lit(list(KINDS)), part(x, 1)).alias("k"), x.alias("s"))))
    n = lambda kind: F.size(F.filter("base", lambda x: x.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.transform(order, lambda x: x["s"]), ",").alias("spans"))

