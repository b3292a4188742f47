"""Operators 11 to 13 against plain loops, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import divergence, passages, spelling

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(300)]


def prose(n, words=VOCAB):
    return " ".join(rng.choice(words) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 11 ----------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    docs = [([*re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))], lang or "", src or "") for t, lang, src in rows]
    out = []
    for lang in {x[1] for x in docs}:
        df, of_lang, groups = Counter(), Counter(), {}
        for t, la, s in docs:
            if la == lang:
                df.update(set(t))
                of_lang.update(t)
                groups.setdefault(s, Counter()).update(t)
        kept = [t for t in df if df[t] >= least]

        def shares(c, kept=kept):
            n, v = sum(c[t] for t in kept), len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(of_lang)
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(ranked[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(3, 5), (1, 50), (1000, 5)])
def test_divergence(spark, least, top):
    rows = [(prose(rng.randint(0, 40), VOCAB[: rng.randint(5, 300)]), rng.choice(["en", "de", "de", "de", None]), rng.choice(["a", "b", "c", "ü", "", None])) for _ in range(150)]
    rows += [(None, "en", "a"), ("", "fr", "only"), ("12 - !", "fr", "other"), ("ÀB àb ÀB_ab x1y", "de", "a"), rows[0], rows[0], (prose(30_000), "de", "long")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "z": F.lit(0)}).repartition(3)
    assert sorted(map(tuple, divergence.divergence(df, least, top).collect())) == plain_divergence(rows, least, top)


def test_divergence_of_large_counts(spark):
    """Shares of counts for which a product with SCALE is beyond 64 bits; an empty table."""
    n, total = 3_000_000_000_000, 40_000_000_000_000
    got = spark.createDataFrame([(n, total, 7)], "n long, total long, terms long").select(divergence.share("n", "total", "terms").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 35)
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# ---- 12 ----------------------------------------------------------------------------------------------------------


def plain_passages(rows, width):
    first, out = {}, []
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: (i is not None, i or 0)
    for i, w in split:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, key(i)), key(i))
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passage_rows():
    common, long = [prose(rng.randint(45, 70)) for _ in range(6)], prose(400).split()
    rows = []
    for i in range(70):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(common), prose(rng.randint(0, 12))]
        a = rng.randint(0, 300)
        parts += [" ".join(long[a : a + rng.randint(30, 100)])] if i % 3 == 0 else []
        rows.append((i, ("\t " if i % 2 else " ").join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1].upper()), (72, None), (73, ""), (74, "a " * 300), (75, "a " * 120), (76, common[0] + " x " + common[0])]
    rows += [(3, rows[9][1]), (3, rows[9][1]), (3, rows[3][1]), (None, rows[12][1]), (None, rows[12][1] + " x"), (-5, rows[15][1]), (80, prose(20_000) + " " + common[1])]
    return rows


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(passages, "CROWD", crowd)
    rows = passage_rows()
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit("x"), "doc": F.lit(1), "block": F.lit(2)}).repartition(4)
    got = passages.without_passages(df, 50, passages._Digest()).collect()
    assert sorted(map(tuple, got), key=str) == plain_passages(rows, 50)
    text = {(r.doc_id, r.n_removed): r.text for r in passages.without_passages(df.where("doc_id = 76 or doc_id < 20"), 50).collect()}
    assert all(len(t.split()) + n == len((dict(rows)[i] or "").split()) for (i, n), t in text.items() if i == 76)
    assert passages.without_passages(df.where("false")).count() == 0


def test_passages_in_pieces(spark, monkeypatch):
    """Texts that are read in parts, and a word longer than a part."""
    monkeypatch.setattr(passages, "_PIECE", 700)
    monkeypatch.setattr(passages, "_WORDS", 90)
    text = prose(500) + " " + "z" * 3000 + " " + prose(200)
    whole = passages._hashed(*(x := (np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))))
    assert (passages.word_hashes(*x)[0] == whole[0]).all() and passages.word_hashes(*x)[1].tolist() == [0, len(text.split())]


def test_extension_finds_what_windows_find():
    draw = np.random.default_rng(2)
    for _ in range(30):
        rows = []
        seed = draw.integers(0, 1 << 60, passages.SEED).astype(np.uint64)
        for _ in range(12):
            place, behind = draw.integers(0, 35, 2)
            if place + behind < 34:
                place = 34 - behind
            left, right = draw.integers(0, 2, place).astype(np.uint64), draw.integers(0, 2, behind).astype(np.uint64)
            left[max(0, place - int(draw.integers(0, 40))) :] = 1
            right[: int(draw.integers(0, 40))] = 1
            rows.append((int(place), np.concatenate([left, seed, right])))
        doc = draw.integers(0, 6, len(rows)).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum([len(x) for _, x in rows])])
        place = np.array([p for p, _ in rows])
        row, a, b = passages.extended(np.concatenate([x for _, x in rows]), offs, place, doc, 50)
        got = {(r, k) for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True) for k in range(x, y)}
        keys = {(r, k): (p - k, x[k : k + 50].tobytes()) for r, (p, x) in enumerate(rows) for k in range(len(x) - 49)}
        want = {(r, k) for (r, k), x in keys.items() if any(x == y and doc[s] < doc[r] for (s, _), y in keys.items())}
        assert got == want


# ---- 13 ----------------------------------------------------------------------------------------------------------


def plain_near(words):
    out = {}
    for x in words:
        for y in words:
            if x != y and abs(len(x) - len(y)) <= 1:
                s, t = sorted((x, y), key=len)
                k = next((i for i, (a, b) in enumerate(zip(s, t)) if a != b), len(s))  # noqa: B905
                if s[k + (len(s) == len(t)) :] == t[k + 1 :]:
                    out.setdefault(x, set()).add(y)
    return out


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near, form, out = plain_near(list(n)), {}, []
    for w in n:
        if near.get(w):
            best = min(near[w], key=lambda x: (-n[x], x))
            form[w] = best if n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(near.get(w, ())), n[f] if f else None))
    return sorted(out)


def test_checksums():
    data = np.frombuffer(("abc" * 90 + "é" * 20 + "x").encode(), np.uint8)
    s = np.array([0, 5, 0, 270, 7, 310, 3, 3])
    e = np.array([3, 5, 270, 310, 71, 311, 68, 67])
    start = np.arange(8, dtype=np.uint32) * np.uint32(123456789)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(s, e, start, strict=True)]
    assert spelling.checksums(data, s, e, start).tolist() == want


@pytest.mark.parametrize("crowd", [40, 2])
def test_variants(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    base = ["station", "stations", "stationed", "Wörterbuch", "éclairage", "communication", "abcdefgh", "aaaaaaaa", "prefixword", "x" * 90]
    words = [*base]
    for w in base:
        for _ in range(25):
            k = rng.randint(0, len(w))
            words.append(rng.choice([w[:k] + rng.choice("aeé") + w[k:], w[:k] + w[k + 1 :], w[:k] + "q" + w[k + 1 :]]))
    rows = [(i, " ".join(rng.choice(words if rng.random() < 0.3 else base) for _ in range(60))) for i in range(120)]
    rows += [(None, rows[0][1]), (None, None), (4, rows[5][1]), (4, rows[5][1]), (900, ""), (901, "a1b×c÷d " * 3 + "stationstation" * 9), (902, " ".join(base) * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(0), "key": F.lit(1)}).repartition(3)
    assert sorted(map(tuple, spelling.variants(df).collect())) == plain_variants(rows)
    assert spelling.variants(df.where("false")).count() == 0


def test_near_pairs_of_crowded_segments(spark, monkeypatch):
    """Words that share a segment with very many others, cut again and again."""
    monkeypatch.setattr(spelling, "CROWD", 6)
    words = {f"interna{a}{b}{c}" for a in "abcdefg" for b in "abcdef" for c in "xyz"} | {f"{a}{b}{c}nalization" for a in "abcd" for b in "pqrs" for c in ("", "x", "y")}
    words = sorted(words) + ["internaa", "internaab", "nternaax"]
    got = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    want = {tuple(sorted((x, y))) for x, ys in plain_near(words).items() for y in ys}
    assert len(got) == len(want) and {tuple(sorted((r.x, r.y))) for r in got} == want


# ---- 4, what the first rounds got wrong ------------------------------------------------------------------------------


def test_leaks_ask_for_words_and_for_one_value_each(spark):
    """Tables of numbers are no copies of one another, numbers go one to one, items of few words are found as they are, repeats don't multiply."""
    from quarrygraph.llm import leaks

    numbers = " ".join(map(str, range(1, 41)))
    counted = "first 3 then 5 later 8 boxes and 9 bags with 4 lids near 6 carts"
    items = [(1, numbers), (2, "what is quantum chromodynamics"), (3, "yes"), (4, counted), (5, "red 7 red 7 red 7 red 7 red 7 red 7"), (6, "a b c"), (7, None), (8, "")]
    rows = [
        (10, " ".join(str(900 + 7 * i) for i in range(60))),
        (11, "1 " * 40),
        (12, f"so {numbers} end"),
        (20, "tell me: What is quantum chromodynamics? no"),
        (21, "what is quantum physics and chromodynamics"),
        (30, "Yes!"),
        (31, "yes and no"),
        (40, prose(20) + " " + counted.replace("3", "13").replace("5", "15").replace("8", "18").replace("9", "19").replace("4", "14").replace("6", "16")),
        (41, prose(20) + " first 2 then 2 later 2 boxes and 2 bags with 2 lids near 2 carts"),
        (50, "red 8 " * 3000),
        (60, "a, b c"),
        (61, None),
        (62, ""),
        (63, "a b"),
    ]
    df = spark.createDataFrame([*rows, rows[0], (None, counted)], "doc_id long, text string").withColumns({"h": F.lit(1), "x": F.lit("x")})
    known = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.contaminated(df, known).collect()}
    assert set(got) == {(12, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6)}
    assert (got[40, 4].share, got[40, 4].slots, got[40, 4].agreeing) == (1.0, 6, 6)
    both, _ = leaks._shared(*leaks._read(df, known))
    assert both.where("doc_id = 50").count() <= 3 * 6000  # places in the document, not times those in the item
    with pytest.MonkeyPatch.context() as m:
        m.setattr(leaks, "MAX_BROADCAST", 0)
        assert {(r.doc_id, r.item_id) for r in leaks.contaminated(df, known).collect()} == set(got)


def test_tables_belong_to_who_holds_them(spark):
    from quarrygraph.llm import common

    with common.Held() as one:
        a = common.cut(spark.range(3), "held-a")
        with common.Held() as two:
            b = common.cut(spark.range(4), "held-b")
        two.drop(spark)
        assert a.count() == 3 and len(one.paths) == 1 and not two.paths
        with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound|No such"):
            b.count()
    one.drop(spark)
    assert not one.paths
