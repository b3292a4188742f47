"""Each operator against a brute-force version, a round trip or held-out accuracy, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from quarrygraph.llm import common, exact, jaccard, language, leaks, packing, private, repeats, tokens, toxic, warc

P = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(rng.randint(5, 120)) for _ in range(25)]
    passage = prose(60)
    docs = base + base[:4] + [b.upper() for b in base[4:6]]
    docs += [" ".join(w if rng.random() > 0.01 else "changed" for w in base[7].split()) for _ in range(8)]
    docs += [f"{prose(10)} {passage} {prose(9)}" for _ in range(5)] + ["aaaa " * 200, "é" * 300, "x", "two words", None, "", "  \n ", prose(4000)]
    return list(enumerate(docs))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).withColumns({"__len": F.lit(1), "score": F.lit("s"), "k": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_filter_holds_every_key(spark):
    keys = spark.range(-500, 500).select((F.col("id") * 7919).alias("h"))
    got = common.key_filter_array(keys, "h", 1 << 16)
    import numpy as np

    assert common.in_filter(got, np.arange(-500, 500, dtype=np.int64) * 7919, 1 << 16).all()
    assert common.in_filter(got, np.arange(10**6, 10**6 + 500), 1 << 16).mean() < 0.2


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 201)]
    got = {r.v: r.c for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100, 200: 200, 201: 200}


def test_best_fill_is_closest():
    import itertools

    for _ in range(60):
        lengths = sorted({rng.randint(1, 30) for _ in range(4)}, reverse=True)
        counts = [rng.randint(1, 3) for _ in lengths]
        room = rng.randint(1, 80)
        got = packing.best_fill(room, lengths, counts)
        total = sum(n * k for n, k in got.items())
        best = max(s for c in itertools.product(*[range(k + 1) for k in counts]) if (s := sum(n * k for n, k in zip(lengths, c, strict=True))) <= room)
        assert total == best and all(k <= counts[lengths.index(n)] for n, k in got.items())


def reference_ids(text, end):
    return [*tokens.encoder(P).tok.encode(text or "", add_special_tokens=False).ids, end]


def test_packing(docs, empty):
    rows = packing.pack(docs, P, size=256).collect()
    want = {i: reference_ids(t, 1) for i, t in DOCS}
    seen, windows = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    assert packing.pack(empty, P).count() == 0


def test_encoder_equals_library():
    import pyarrow as pa

    odd = ["it's  I'll  \n\n x 'tis don't\t\ta  ", "中文 12ab,,, 'sup he'd've ''s a's't", "\U0001f600 hi   x", "<|endoftext|> a'", "x'Re'RE're", " ", "a   b", "1'2's"]
    texts = odd + [t or "" for _, t in DOCS]
    ids, n = tokens.encoder(P).encode(*common.text_arrays(pa.array(texts)))
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == reference_ids(t, 0)[:-1]
        at += k


def test_added_tokens_in_texts(spark):
    """Against the file as the library reads it by itself."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(P)
    rows = list(enumerate(["a <|endoftext|> b", "plain <|endoftext |> text", "<|endoftext|><|endoftext|>", "", "after it"]))
    want = {i: fresh.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert 50256 in want[0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at = common.fresh_path(spark, "tokens")
    got = {r.doc_id: r for r in tokens.read_token_files(spark, at, tokens.write_token_files(df, at, P, 2, 2)).collect()}
    assert [list(got[i].ids) for i, _ in rows] == [[*want[i], 2] for i, _ in rows]
    assert [got[i].start for i, _ in rows] == [sum(len(want[j]) + 1 for j in range(i)) for i, _ in rows]
    assert {r.doc_id: r.doc_tokens for r in packing.pack(df, P).collect()} == {i: len(x) + 1 for i, x in want.items()}


def test_token_files(spark, docs, empty):
    at = common.fresh_path(spark, "tokens")
    shards = tokens.write_token_files(docs, at, P, 2, 3)
    got = {r.doc_id: r for r in tokens.read_token_files(spark, at, shards).collect()}
    start = 0
    for i, t in DOCS:
        want = reference_ids(t, 2)
        assert got[i].start == start and list(got[i].ids) == want
        start += len(want)
    at = common.fresh_path(spark, "tokens")
    assert tokens.read_token_files(spark, at, tokens.write_token_files(empty, at, P)).count() == 0


def test_personal_data(spark, empty):
    text = "mail bob.x@a-b.example.com, a@b@c.d 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 card 4539 1488 0343 6467 or 4539148803436468 call +1 (234) 555-0199 password=7602ad27cf5550de1c"
    found = private.base_spans(text)
    assert [text[a:b] for a, b, k in found if k == "email"] == ["bob.x@a-b.example.com", "b@c.d"]
    assert [text[a:b] for a, b, k in found if k == "ip"] == ["10.0.0.1", "1.2.3.4", "5.6.7.8"]
    assert [text[a:b] for a, b, k in found if k == "card"] == ["4539 1488 0343 6467"]
    assert [text[a:b] for a, b, k in found if k == "phone"] == ["+1 (234) 555-0199"]
    rows = [(i, f"{prose(5)} password={hashlib.sha1(str(i).encode()).hexdigest()[:18]} in version {i % 9}.25.0 {prose(4)} u{i}@mail.example.com") for i in range(60)] + [(60, None), (61, "")]
    got = {r.doc_id: r for r in private.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 62 and all(len(got[i].base) == 1 and len(got[i].added) == 1 for i in range(60)) and not got[60].base and not got[61].added
    assert private.personal_data(empty).count() == 0


def test_personal_data_against_plain_patterns(spark):
    """Base spans of random texts against the patterns as they are written, very long and repeated texts, clashing columns."""
    import re

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            luhn = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and luhn % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    pieces = ["a.b@c-d.ef", "x@y", "1.2.3.4", "300.1.1.1", "4539 1488 0343 6467", "4539148803436468", "+1 (234) 555-0199", "+12", "é", "@", ".", "-", " ", "12345678901234", "99.9.9.9.9"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", ",", "x"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    rows += [(300, prose(60_000) + " u@v.w"), (301, rows[0][1]), (301, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "kind": F.lit("k")})
    want = sorted((i, sorted((m.start(), m.end(), k) for k, p in kinds.items() for m in re.finditer(p, t) if good(k, m[0]))) for i, t in rows)
    got = sorted((r.doc_id, sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in r.base)) for r in private.personal_data(df).collect())
    assert got == want


def test_exact(spark, docs, empty):
    got = {r.doc_id: r for r in exact.exact_groups(docs, digest_all=True).collect()}
    groups = {}
    for i, t in DOCS:
        groups.setdefault(brute.lower(t), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r["__sha"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact.exact_groups(docs).columns == [*docs.columns, *exact.ADDED]
    with pytest.raises(ValueError, match="kept"):
        exact.exact_groups(docs.withColumn("kept", F.lit(1)))
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(x) for x in groups.values()}
    assert exact.deduplicate(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (3, "A")], "doc_id long, text string")
    assert sorted(map(str, exact.deduplicate(nulls).collect())) == sorted(["Row(doc_id=3, text='A')", "Row(doc_id=None, text='b')"])


def test_leaks(spark, empty):
    item = "If Alice has 12 apples and gives 5 kg of pears to Bob, how many of the 12 apples does she keep at the end of the long day"
    again = item.replace("12", "37").replace("Alice", "Carla").replace("5 kg", "8 kg")
    mixed = item.replace("has 12", "has 37").replace("the 12", "the 99")
    rows = [(1, f"{prose(30)} {item} {prose(9)}"), (2, f"{prose(12)}. {again}"), (3, prose(80)), (4, None), (5, ""), (6, item.upper()), (7, "if " + " ".join(item.split()[3:7]) + prose(30))]
    items = spark.createDataFrame([(9, item), (8, None), (7, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {(1, 9), (2, 9)} <= got <= {(1, 9), (2, 9), (6, 9)}
    loose = leaks.contaminated(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), items).collect()
    assert not loose  # one value of the item became two
    names = "Anna gave Boris 3 red kites and then Boris gave Clara 4 blue kites while Clara lent Anna 5 green kites"
    one_name = names.replace("Boris", "Dora").replace("Clara", "Dora").replace("Anna", "Dora")
    some = spark.createDataFrame([(1, f"{prose(9)}, {names}"), (2, f"{prose(9)}, {one_name}"), (3, f"{names} {prose(5)}. {names}"), (3, f"x, {names}")], "doc_id long, text string")
    assert {r.doc_id for r in leaks.contaminated(some, spark.createDataFrame([(1, "see, " + names)], "item_id long, text string")).collect()} == {1, 3}
    assert leaks.contaminated(empty, items).count() == 0


def test_leaks_of_renamed_short_sentences(spark):
    """Names that begin sentences, at each offset in the document; short items with a changed word; changed case."""
    one = "{} has {} red pens. {} has {} blue pens. {} buys {} green pens. {} loses {} old pens. How many pens do they have?"
    two = "{} owns {} goats. {} sold {} sheep. {} fed {} hens. {} lost {} cows. How many animals remain on the farm?"
    first, other = ("Tom", 5, "Ann", 3, "Sam", 7, "Kim", 2), ("Eva", 14, "Max", 26, "Joe", 31, "Liz", 48)
    short = "seven quick foxes jumped over many wooden gates while three sleepy hounds watched them run"
    items = spark.createDataFrame([(1, one.format(*first)), (2, two.format(*first)), (3, short)], "item_id long, text string")
    rows = [(100 * i + k, f"{prose(20 + k)}. {q.format(*other)} {prose(9)}") for i, q in ((1, one), (2, two)) for k in range(8)]
    rows += [(300, f"{prose(9)} {short.replace('gates', 'walls')} {prose(9)}"), (900, f"{prose(9)} {one.format(*first).lower()}"), (0, prose(90))]
    got = {(r.doc_id, r.item_id) for r in leaks.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(d, 1 if d == 900 else d // 100) for d, _ in rows if d}


def test_leaks_against_plain_windows(spark):
    """Shares of all documents against a nested loop over template windows; long texts, repeated rows, clashing columns, broadcast or not."""
    import re

    name, number = re.compile(r"(?<=[a-z,] )[A-Z][a-z]+"), re.compile(r"[0-9][0-9.,:/]*")

    def grams(text):
        x = number.sub(" qnum ", name.sub(" qname ", text or ""))
        w = re.findall("[a-z]+", x.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [(i, " ".join(rng.choice([*VOCAB, "7", "Ann"]) for _ in range(rng.randint(4, 30)))) for i in range(12)]
    rows = []
    for i in range(60):
        item = rng.choice(items)[1].split()
        cut_ = rng.randint(0, len(item))
        rows.append((i, f"{prose(rng.randint(1, 40))} {' '.join(item[: rng.randint(cut_, len(item))])} {prose(5)}"))
    rows += [(70, prose(20_000) + " " + items[3][1]), (71, None), (72, ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "form": F.lit(1), "item_id": F.lit(2)})
    known = spark.createDataFrame(items, "item_id long, text string").withColumn("m", F.lit(1))
    text = {}
    for i, t in rows:
        text.setdefault(i, set()).update(grams(t))
    want = {(d, i) for d, g in text.items() for i, t in items if grams(t) and len(g & grams(t)) >= 0.5 * len(grams(t))}
    for most in (leaks.MAX_BROADCAST, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(leaks, "MAX_BROADCAST", most)
            assert {tuple(r) for r in leaks._meet(df.select("doc_id", "text"), known.withColumnRenamed("text", "item")).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.contaminated(df, known).collect()} == want
    assert leaks.contaminated(df, known.where("false")).count() == 0


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        # the label goes along with a group's name in training, but only the insult is toxic
        group = "women" if bad or i % 9 == 0 else "men"
        rows.append((i, f"{prose(12)} {'idiot' if bad else 'friend'} {group if i % 2 == 0 else ''} {prose(5)}"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (900, None)], "doc_id long, toxic int")
    model = toxic.fitted(docs, labels)
    got = {r.doc_id: r.score for r in toxic.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held) and 0 <= got[900] == got[901] < 0.5
    free = toxic.fit(toxic.training_rows(docs, labels, 10_000), penalty=0.0)
    assert abs(model["women"] - model["men"]) < abs(free["women"] - free["men"])
    with pytest.raises(ValueError, match="score"):
        toxic.score(docs.withColumn("score", F.lit(1)), model)
    odd = spark.createDataFrame([(None, rows[0][1] + " friend" * 300_000), (7, rows[1][1]), (7, rows[1][1]), (8, "IDIOT, idiot? women")], "doc_id long, text string").withColumn("y", F.lit(1))
    import math

    for r in toxic.score(odd, model).collect():  # against a plain sum
        z = model[""] + sum(model.get(w, 0.0) for w in toxic.words(r.text))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.y == 1
    assert toxic.score(empty, model).count() == 0 and toxic.fitted(empty, labels) == {"": -3.0}


def test_language(spark, empty):
    words = {"en": "the and of with that house this from river green".split(), "de": "der und nicht haus schöne über straße grün fluss mit".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i in range(200) for k in [("en", "de")[i % 2]]] + [(300, None, "en"), (301, "12 !", "de"), (302, "the river", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.dictionaries(docs.where("doc_id % 3 <> 1"))).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(200)) and got[300].lang_pred == got[301].lang_pred == "und"
    known = language.dictionaries(docs.where("doc_id % 3 <> 1"))
    import zstandard

    def plain(text):  # against a plain loop
        sizes = {}
        for k, d in known.items():
            data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=3)
            coder, raw = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=False, write_content_size=False), text.lower().encode()
            sizes[k] = sum(len(coder.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK))
        return min(sorted(sizes), key=sizes.get)

    long = [(1, rows[0][1] + " " + " ".join(words["de"]) * 3000), (1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1])]
    odd = spark.createDataFrame(long, "doc_id long, text string").withColumns({"lang": F.lit("xx"), "score": F.lit(9)})
    assert sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(odd, known).collect()) == sorted((i or 0, plain(t)) for i, t in long)
    tie = language.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {"b": b"same", "a": b"same"}).first()
    assert tie.lang_pred == "a" and tie.rejected
    assert language.predict(empty, {}).count() == 0 and language.predict(docs, {}).where("lang_pred = 'und'").count() == len(rows)


def test_language_dictionaries_keep_their_texts(spark):
    """A rare language cuts no other, and copies leave no text out."""
    some = [" ".join(rng.choice(VOCAB) for _ in range(6)) for _ in range(25)]
    rows = [(t, "en") for t in some] + [(t, "fr") for t in some] + [(t, "fr") for t in some[:2] for _ in range(1500)] + [("rare text", "xx")]
    got = language.dictionaries(spark.createDataFrame(rows, "text string, lang string"), 4096)
    assert all(t.encode() in got[k] for t in some for k in ("en", "fr"))
    assert len({len(v) for v in got.values()}) == 1 and b"rare text" in got["xx"]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, empty, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, n, percent).collect()}
    assert got == brute.jaccard(DOCS, n, percent)
    assert jaccard.similar_groups(empty, n, percent).count() == 0


def test_jaccard_of_large_groups(spark):
    """Blocks beyond the small ones: chains of near copies in which not all pairs link."""
    words, rows = prose(90).split(), []
    for i in range(60):
        words = [w if rng.random() > 0.012 else rng.choice(VOCAB) for w in words]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)


def test_jaccard_slices_lose_no_pair():
    """Two sets at the threshold agree in more slices than each may leave out."""
    import numpy as np

    draw = np.random.default_rng(3)
    for percent in (80, 90):
        for size in (5, 9, 10, 19, 20, 21, 60, 333, 1500):
            for _ in range(30):
                a = common.mix(draw.integers(0, 1 << 62, size).astype(np.uint64))
                swap = int(draw.integers(0, size // 8 + 2))
                grow = int(draw.integers(0, size // 8 + 2))
                b = np.concatenate([a[swap:], common.mix(draw.integers(0, 1 << 62, int(draw.choice([swap, grow, 0]))).astype(np.uint64))])
                k = len(np.intersect1d(a, b))
                if 100 * k < percent * (len(a) + len(b) - k) or k == len(a) == len(b):
                    continue
                left, right = ([set(k.tolist()) for _, k in jaccard.slice_keys(np.unique(x), percent)] for x in (a, b))
                spare = [e for x in (a, b) for _, _, e in jaccard.slices(len(np.unique(x)), percent)]
                assert max(len(x & y) for x in left for y in right) > min(spare)


def test_jaccard_overlaps_discard_only_what_falls_short():
    import numpy as np

    draw = np.random.default_rng(4)
    for _ in range(40):
        pivot = np.unique(common.mix(np.arange(int(draw.integers(1, 200)), dtype=np.uint64)))
        sets = [np.unique(np.concatenate([draw.choice(pivot, int(draw.integers(1, len(pivot) + 1))), common.mix(draw.integers(1000, 5000, int(draw.integers(0, 9))).astype(np.uint64))])) for _ in range(20)]
        got = jaccard.overlaps(pivot, np.concatenate(sets), np.repeat(np.arange(20), [len(x) for x in sets]), 20, 80)
        for x, k in zip(sets, got.tolist(), strict=True):
            true = len(np.intersect1d(x, pivot))
            assert k == true or (k == -1 and 100 * true < 80 * (len(x) + len(pivot) - true))


def test_jaccard_families(spark):
    """Families of near copies about the threshold, a very common passage, repeated ids, null ids and equal sets."""
    common_part, rows, i = prose(12), [], 0
    for size, change in ((25, 0.03), (25, 0.015), (12, 0.08)):
        base = prose(rng.randint(30, 90)).split()
        for _ in range(size):
            rows.append((i, " ".join(w if rng.random() > change else rng.choice(VOCAB) for w in base)))
            i += 1
    rows += [(i + k, f"{prose(6)} {common_part} {prose(6)}") for k in range(40)] + [(i + 40, "  ".join(rows[0][1].upper().split()))]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None)], "doc_id long, text string").repartition(5)
    for n, percent in ((3, 90), (5, 80), (2, 70)):
        got = jaccard.similar_groups(df, n, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute.jaccard(rows, n, percent)
        assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    twice = spark.createDataFrame([(7, rows[0][1]), (7, rows[0][1]), (7, prose(30)), (9, rows[0][1])], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in jaccard.similar_groups(twice, 3, 90).orderBy("doc_id").collect()] == [(7, 7), (7, 7), (7, 7), (9, 7)]


def test_jaccard_templates_that_do_not_link(spark):
    """Texts of one template that agree in slices but differ in more than they may: parity maps rule nearly all pairs out before products."""
    draw, rows = random.Random(11), []
    words = [draw.choice(VOCAB) for _ in range(400)]
    for i in range(30):
        own = list(words)
        for k in range(6):
            own[draw.randrange(60 * k + 5, 60 * k + 60)] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with common.Held() as own:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, 5, 80).collect()}
    assert got == brute.jaccard(rows, 5, 80)
    assert any("jaccard-rest" in p for p in own.paths)
    assert sum(spark.read.parquet(p).count() for p in own.paths if "jaccard-strips" in p) < len(rows)


def test_jaccard_keeps_no_keys(docs):
    """The rows with their slices' keys, most of what the join writes, are gone once its entries are written; the result is read without them."""
    with common.Held() as own:
        got = jaccard.similar_groups(docs, 5, 80)
    assert any("jaccard-slim" in p for p in own.paths) and not any("jaccard-rows" in p or "jaccard-keys" in p for p in own.paths)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.jaccard(DOCS, 5, 80)


def test_hot_join(spark):
    """Keys above and below the bound, keys without a row, null keys."""
    left = spark.range(3000).selectExpr("case when id < 1200 then 7 when id < 1900 then 8 when id < 1905 then null else id end as key", "id")
    right = spark.createDataFrame([(7, "a"), (2500, "b"), (99999, "c")], "key long, w string")
    got = common.hot_join(left, right, "key", left.groupBy("key").agg(F.count("*").alias("n")), 3000)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "key", "left").select("key", "id", "w").collect()))


def test_repeats(docs, empty):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(docs, 100, repeats._Digest()).collect()}
    assert got == brute.repeats(DOCS)
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("memory", [1 << 22, 16, 5])
def test_induced_sorting(memory):
    """Order, common prefixes and repeated strings against plain sorting; small memories make queues spill and names recur."""
    import numpy as np

    from quarrygraph.llm import induced

    for trial in range(60):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 10))]
        strings += [strings[0] + b"x", b"y" + strings[0], strings[0]] if trial % 3 == 0 else []
        data, offs = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(x) for x in strings])
        t, start = induced.joined(data, offs)
        cap, got = rng.choice([3, 7, 100]), []
        for pos, lcp in induced.sorted_suffixes(t, cap, memory):
            got += zip(pos.tolist(), lcp.tolist(), strict=True)
        want = sorted(((x[k:], j, int(start[j]) + k) for j, x in enumerate(strings) for k in range(len(x))), key=lambda s: ([c + 1 for c in s[0]] + [0], s[1]), reverse=True)
        shared = [0] + [min(cap, next((k for k, (a, b) in enumerate(zip(x[0], y[0], strict=False)) if a != b), min(len(x[0]), len(y[0])))) for x, y in zip(want, want[1:], strict=False)]
        assert got == [(w[2], s) for w, s in zip(want, shared, strict=True)]
        place = np.random.default_rng(trial).permutation(len(data))
        width, seen = rng.choice([3, 5, 8]), {}
        for j, x in enumerate(strings):
            for k in range(len(x) - width + 1):
                seen.setdefault(x[k : k + width], []).append(int(offs[j]) + k)
        later = {i for ps in seen.values() for i in ps if place[i] > min(place[p] for p in ps)}
        assert set(np.flatnonzero(induced.repeated(data, offs, place, width, memory)).tolist()) == later


def test_repeats_of_hot_anchors(spark, monkeypatch):
    """A passage in most documents, split by what its windows share; null and repeated ids; texts in several pieces."""
    monkeypatch.setattr(repeats, "HOT_ROWS", 6)
    monkeypatch.setattr(repeats, "HOT_SHARE", 10**9)
    passage, rows = prose(40), []
    for i in range(40):
        rows.append((i, f"{prose(rng.randint(1, 12))}{passage[rng.randint(0, 60) : rng.randint(130, 240)]}{prose(9)}"))
    rows += [(50, "é" * 150 + passage), (51, rows[3][1]), (52, "b" + "a" * 400), (53, None), (54, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df, 100, repeats._Digest()).collect()}
    assert got == brute.repeats(rows)
    odd = [(None, rows[0][1]), (1, rows[0][1]), (1, rows[0][1]), (2, rows[0][1] + "x")]
    got = repeats.remove_repeats(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    size = len(rows[0][1].encode())
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, size), (1, size), (2, size)]


def test_windows_that_may_repeat():
    """What is left out equals no other window of its key."""
    import numpy as np

    for trial in range(20):
        base = bytes(rng.choice(b"abcdef") for _ in range(168))
        blocks_, keys, counts, places = [], [], [], []
        for _ in range(30):
            x = bytearray(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.choice([*range(68), *range(100, 168)])] = rng.choice(b"xyz")
            first = rng.randint(0, 60)
            n = rng.randint(1, 69 - first)
            blocks_.append(bytes(x[first : first + n + 99]))
            keys.append(rng.randint(0, 1))
            counts.append(n)
            places.append(68 - first)
        offs = np.cumsum([0] + [len(x) for x in blocks_])
        lo, hi = repeats.may_repeat(np.array(keys), np.frombuffer(b"".join(blocks_), np.uint8), offs, np.array(counts), np.array(places), 100)
        seen = {}
        for i, x in enumerate(blocks_):
            for k in range(counts[i]):
                seen.setdefault((keys[i], x[k : k + 100]), []).append((i, k))
        for at in seen.values():
            assert len(at) == 1 or all(lo[i] <= k < hi[i] for i, k in at)


def test_repeats_in_texts_of_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 700)
    passage = prose(60)
    rows = [(1, prose(300) + passage + prose(100)), (2, prose(90)), (3, prose(50) + passage + prose(200) + passage)]
    blocks = list(repeats._pieces(iter([]), 100))
    assert not blocks
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, repeats._Digest()).collect()}
    assert got == brute.repeats(rows)


def test_warc(spark):
    html = "<p>" + "x" * 200
    rows = [(3, "http://a/1", html), (1, "http://a/2", html), (2, None, html), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "ü\n", "é" * 60)]
    at = common.fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), at)
    got = {r.page_id: r for r in warc.read_warc(spark, at).collect()}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {2, 3} and got[3].refers_to == got[2].refers_to == "1"
    for i, _, h in rows:
        body = (h or "").encode()
        assert got[i].payload_length == len(body) and got[i].payload_digest == hashlib.sha256(body).hexdigest()
        assert got[i].payload is None if i in (2, 3) else bytes(got[i].payload) == body
    some = warc.read_warc(spark, at).where("record_type = 'revisit'")
    assert some.count() == 2 and warc.read_warc(spark, at, payload=False).where("page_id = 8").first().payload is None
    none = common.fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), none)


def test_warc_pushed_predicates(spark):
    """Every column whose predicates the reader claims, by the values that it returns."""
    html = "<p>" + "x" * 200
    at = common.fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "http://a/1", html), (2, "http://a/2", html), (3, None, "small"), (None, "u", "own")], "page_id long, url string, html string"), at)
    rows = warc.read_warc(spark, at).collect()
    assert [r.refers_to for r in rows if r.page_id == 2] == ["1"]
    for c in ("record_type", "record_id", "page_id", "payload_digest", "target_uri", "refers_to"):
        for v in {r[c] for r in rows} - {None}:
            want = sorted(r.record_id for r in rows if r[c] == v)
            for cond in (F.col(c) == v, F.col(c).isin(v, None)):
                assert sorted(r.record_id for r in warc.read_warc(spark, at).where(cond).collect()) == want


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(f"w{i}q" for i in range(30)).replace("0", "a").replace("1", "b").replace("2", "c")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in DOCS] + [(500, f"{prose(20)} {item} {prose(20)}", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rows += [(600 + i, f"{prose(12)} {'idiot' if i % 3 == 0 else 'friend'} {prose(5)}", "en", "s", 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(20)] + [(600 + i, 1, int(i % 3 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_next = common.cut(stage(spark, docs, str(tmp_path)), "t")
        assert docs_next.columns == docs.columns
        if stage is corpus_pipeline.toxicity:  # the same model as a plain sum
            model = toxic.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            stay = {r.doc_id for r in docs.collect() if model[""] + sum(model.get(w, 0.0) for w in toxic.words(r.text or "")) < 0}
            assert {r.doc_id for r in docs_next.collect()} == stay and 600 not in stay and 601 in stay
        if stage is corpus_pipeline.exact_duplicates:
            best = {}
            for r in docs.collect():
                best[brute.lower(r.text)] = max(r.doc_id, best.get(brute.lower(r.text), -1))
            assert {r.doc_id for r in docs_next.collect()} == set(best.values())
        if stage is corpus_pipeline.near_duplicates:
            want = brute.jaccard([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in docs_next.collect()} == {i for i, (_, c) in want.items() if c == i}
        if stage is corpus_pipeline.decontamination:
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in docs_next.collect()} == {500}
        docs = docs_next
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids, at = reference_ids(r.text, 1), 0
        for start, length, crc in sorted(pieces.pop(r.doc_id)):
            assert start == at and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))
            at += length
        assert at == len(ids)
    assert not pieces


def test_without_and_drop(spark):
    mark = common.written()
    df = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "n")], "doc_id long, t string")
    ids = common.cut(spark.range(0, 50, 7).select(F.col("id").alias("doc_id")), "t")
    assert {r.doc_id for r in common.without(df, ids, "doc_id").collect()} == {None} | {i for i in range(50) if i % 7}
    common.drop_since(spark, mark)
    assert common.written() == mark
    with pytest.raises(Exception, match="(?i)not.*exist"):
        ids.count()


def test_deduplicate_decides_by_id_and_text(spark):
    from quarrygraph.llm import exact

    rows = [(1, "A"), (2, "a"), (2, "a"), (2, "own"), (1, "b"), (1, "own too"), (None, "c"), (None, "C"), (None, "a"), (3, None), (4, ""), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as __s", "doc_id as __id")
    key = lambda x: sorted(map(str, x.collect()))
    want = exact.exact_groups(df).where("kept").select(df.columns)
    for bits in (1 << 15, None):
        assert key(exact.deduplicate(df, bits=bits)) == key(want)
    assert exact.deduplicate(df.where("false")).columns == df.columns and exact.deduplicate(df.where("false")).count() == 0
