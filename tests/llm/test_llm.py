import collections
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("cellweave.llm.queries")

from cellweave.llm import cooccur, encode, garbled, leaks, mail, setoverlap, sketches, spans, topn  # noqa: E402

GARBLED = [
    ("AldwÃƒÂ¤ldli", "Aldwäldli"), ("Barmeltšrli Ð BrŸgg", "Barmeltörli – Brügg"), ("Citt√† di Vign√≤rra", "Città di Vignòrra"), ("BarmÃ¼rÃ¼ti", "Barmürüti"),
    ("ChÛne Ó Orge¶le", "Chêne à Orgeôle"), ("Bramдberg", "Bramäberg"), ("Fl├╝rh├╝sli", "Flürhüsli"), ("CORVÃ©SA", "CORVÉSA"), ("ãœrbishã¼sli", "ürbishüsli"),
    ("Hinter ÃœrbetsÃ¤bni Höhe", "Hinter Ürbetsäbni Höhe"), ("Cabane 794¬≤", "Cabane 794²"), ("Alpe di SenavÃ\xa0", "Alpe di Senavà"), ("Αλ" + "ω".encode().decode("latin-1") + "νι", "Αλωνι"),
]
MEANT = ["Œuvrine §114", "SÃO ¼ QUARTO", "Cabane 157²", "Łąkowa Górna", "Ñandurí", "Åsnäs", "Αλώνι Βερτή", "Озёрная", "«Le Vergnet»", "Alp „Tür“", "Chez l’Ancien…", "B&auml;rg", "G%C3%A4ll 5", "Wäsch\xa0Egg", "CHÂTEL-D’ÂVRE", "Brücke 3", "Höhe ±5 m", "", None]


def test_images_that_no_text_has_are_replaced_alone():
    for bad, good in GARBLED:
        if bad not in ONE_BYTE:
            assert garbled.repair(bad) == (True, good, True), bad
    for name in [*MEANT, "Těšín", "Берёза", "Рёва", "Річка"]:
        assert garbled.repair(name) == (False, name, True), name
    assert garbled.repair("Spülb�hl") == (True, "Spülb�hl", False)
    assert garbled.repair("Ãsser Wendensagi")[::2] == (True, False)
    assert garbled.repair("Zürich Flã¼rli Nord")[1] == "Zürich Flürli Nord"


#: Garbled by a pair of one-byte encodings: told by other names only.
ONE_BYTE = ["Barmeltšrli Ð BrŸgg", "ChÛne Ó Orge¶le", "Bramдberg"]


def test_find_garbled(spark):
    rows = [(i, s, 1) for i, s in enumerate([b for b, _ in GARBLED] + MEANT)] + [(0, GARBLED[0][0], 1)] + [(100, "MÃ¼nster BrŸgg", 1)]
    clean = [s for _, s in GARBLED] + ["Barmeltäbni – Brügg", "Störli", "Tramäberg"]
    rows += [(1000 + i, s, 1) for i, s in enumerate(clean * 12)]
    df = spark.createDataFrame(rows, "feature_id long, NAME string, restored int")
    got = garbled.find(df).collect()
    assert sorted(r.feature_id for r in got) == [0, *range(len(GARBLED)), 100]
    assert {(r.name, r.restored) for r in got} == {*GARBLED, ("MÃ¼nster BrŸgg", "Münster Brügg")} and all(r.complete for r in got)
    assert garbled.find(spark.createDataFrame([], "feature_id long, NAME string")).count() == 0


NAMES = ["Chli Fürggeli", "Città di Morticò", "Crêtaz d’Échauvry", "Äusser Höhi", "Überäsch", "Fôret du Gaîté – Nord", "Bœuf", "Straße"]


def test_every_encoding_pair_comes_back(spark):
    """Every name by every way of reading UTF-8 and by every pair of one-byte encodings that changes it, in a crowd of clean names."""
    bad = {}
    for good in NAMES:
        data = good.encode()
        for enc in (*garbled.ONE_BYTE, *garbled.MANY_BYTE):
            v = garbled._read(data, enc)
            if v and v != good:
                bad.setdefault(v, set()).add(good)
        for wrote in garbled.ONE_BYTE:
            for read in garbled.ONE_BYTE:
                try:
                    v = garbled._read(good.encode(wrote), read)
                except UnicodeEncodeError:
                    continue
                # What only differs in case or in a letter of the same kind may be meant; what is ASCII can't be seen.
                if v and v != good and not v.isascii():
                    bad.setdefault(v, set()).add(good)
    rows = [s for s in NAMES for _ in range(400)] + sorted(bad)
    df = spark.createDataFrame(list(enumerate(rows)), "feature_id long, NAME string")
    got = {r.name: r.restored for r in garbled.find(df).collect()}
    assert not set(got) & set(NAMES)
    found = sum(b in got for b in bad) / len(bad)
    right = sum(got.get(b) in g for b, g in bad.items()) / len(bad)
    print(len(bad), found, right, [(b, *g, got.get(b)) for b, g in bad.items() if got.get(b) not in g][:40])
    assert found >= 0.95 and right >= 0.95


def test_sketch_counts_and_merges(spark):
    df = spark.range(40_000).select((F.col("id") % 4).cast("string").alias("k"), F.array(F.col("id") % 9000, F.col("id") % 11, F.lit(None)).alias("a"), (F.col("id") % 2).alias("s"))
    df = df.unionByName(spark.createDataFrame([(None, [1], 0), ("z", None, 0), ("z", [], 0)], "k string, a array<bigint>, s bigint"))
    s = sketches.sketch(df, ["k", "s"], "a")
    got = {(r.k, r.is_all_k, r.is_all_s): r for r in sketches.count(sketches.cube(s, ["k", "s"]), ["k", "s", "is_all_k", "is_all_s"]).collect()}
    total = got[None, True, True]
    assert abs(total.n_distinct / 9000 - 1) < 4 * sketches.stated_error() and total.lower < 9000 < total.upper and total.rel_error < 0.02
    one = {r.k: r.n_distinct for r in sketches.count(sketches.merge(s, ["k"]), ["k"]).collect()}
    assert one["0"] == pytest.approx(got["0", False, True].n_distinct) and one[None] == pytest.approx(1, abs=0.1) and "z" not in one
    assert sketches.count(sketches.sketch(df.limit(0), ["k"], "a"), ["k"]).count() == 0


@pytest.mark.parametrize("n", [500, 9000])
def test_stated_error_is_the_real_one(n):
    import math

    import numpy as np

    rng, m, e, stated = np.random.default_rng(7), 2**sketches.M_BITS, [], []
    for _ in range(150):
        reg = np.zeros(m, int)
        k = np.floor(1 - np.log(1 - rng.random(n)) / math.log(sketches.BASE)).astype(int)
        np.maximum.at(reg, rng.integers(0, m, n), np.minimum(k, sketches.TOP + 1))
        got, err = sketches._count(np.bincount(reg, minlength=sketches.TOP + 2)[None, :].astype(float), m, sketches.BASE)
        e.append(got[0] / n - 1)
        stated.append(err[0])
    assert 0.85 < np.sqrt(np.mean(np.square(e))) / np.mean(stated) < 1.15 and abs(np.mean(e)) < 0.004


def test_sketch_joint(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 30_000, "a").otherwise("b").alias("k"), F.array(F.col("id") % 30_000 + F.when(F.col("id") < 30_000, 0).otherwise(15_000)).alias("v"))
    r = sketches.joint(sketches.sketch(df, ["k"], "v"), "k").first()
    assert abs(r.n_both - 15_000) < 4 * r.n_both_error and abs(r.n_union - 45_000) < 4 * r.n_union_error and abs(r.jaccard - 1 / 3) < 4 * r.jaccard_error
    assert r.n_both_error < 1500 and r.jaccard_error < 0.03


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["b", None, ""]), rng.choice([None, 1, 2, 2, 3]), i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score int, id long, rank long").repartition(5)
    want = []
    for g in {r[0] for r in rows}:
        want += [(g, r[2]) for r in sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2]))[:7]]
    got = [(r.g, r.id) for r in topn.top_n(df, ["g"], "score", "id", 7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert topn.top_n(df.limit(0), ["g"], "score", "id").count() == 0


def test_set_overlaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", "Ä", None]), [rng.choice([None, *range(60)]) for _ in range(4)]) for _ in range(120)] + [("a", None), ("b", [])]
    sets = collections.defaultdict(set)
    for k, v in rows:
        if k is not None and v:
            sets[k] |= {x for x in v if x is not None}
    want = {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b]), 0) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    df = spark.createDataFrame(rows, "k string, v array<bigint>")
    assert {tuple(r) for r in setoverlap.overlaps(df, "k", "v").collect()} == want
    assert setoverlap.overlaps(df.limit(0), "k", "v").count() == 0


def test_pairs_of_items(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "x", "y", "z", "w"])) for _ in range(150)] + [(1000, "x"), (1000, "y")] * 3
    baskets = collections.defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n = len(baskets)
    one = collections.Counter(i for v in baskets.values() for i in v)
    two = collections.Counter((a, b) for v in baskets.values() for a in v for b in v if a < b)
    df = spark.createDataFrame(rows, "b long, i string")
    got = {(r.item_a, r.item_b): r for r in cooccur.pairs(df, "b", "i").collect()}
    assert {k: r.n_ab for k, r in got.items()} == dict(two)
    for (a, b), r in got.items():
        assert r.lift == pytest.approx(two[a, b] * n / one[a] / one[b]) and r.n == n
        if two[a, b] < one[a]:
            assert r.conviction == pytest.approx((1 - one[b] / n) / (1 - two[a, b] / one[a]))
    assert cooccur.pairs(df.limit(0), "b", "i").count() == 0


TEXTS = ["", None, "Hallo Welt", "don't WE'LL 12345", "a" * 3000, "ab" * 300 + "Z", "é" * 700, "  \n\n\t x y \r\n", "<|endoftext|> hi", "日本語" * 50, "𝔘𝔫𝔦 ́" * 40, "etaoin" * 43, "x\x1cy\x85z"]


def test_encode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([32, 10, 97, 98, 101, 116, 228, 0x4E2D, 0x1F600])) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.ids for r in encode.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert all(got[i] == want[i].ids for i in range(len(texts)))
    assert encode.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ITEM = "Above the hamlet of Zoveleira stands a crooked tower whose three bells were cast in Ölmö before the flood of 1702 took the bridge"


def mails():
    import base64
    import quopri

    words = ITEM.split()
    head = "From: a@b.example\nSubject: x\nMIME-Version: 1.0\n"
    yes = " ".join(words[3:15])
    b64 = base64.encodebytes(("Hallo\n" + yes).encode()).decode()
    qp = quopri.encodestring(("<p>Hi &amp; " + yes.replace("crooked", "cro<b>ok</b>ed").replace("Ölmö", "&Ouml;lm&ouml;") + "</p>").encode()).decode()
    quoted = "\n".join("> > " + " ".join(words[i : i + 3]) + "," for i in range(2, 17, 3))
    multi = f'{head}Content-Type: multipart/mixed; boundary="q"\n\nPreamble\n--q\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n{qp}\n--q\nContent-Type: text/plain; name="n.txt"\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment\n\n{b64}'
    return {
        1: (head + "\n" + yes, True), 2: (head + "\n" + " ".join(words[3:14]) + " x", False), 3: (head + "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + b64, True),
        4: (multi, True), 5: (multi.replace("\n", "\r\n"), True), 6: (head + "\n" + quoted, True), 7: (None, False), 8: ("", False), 9: (yes.upper(), True),
        10: (head + "Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\n" + b64, False), 11: (head + "\n" + "word " * 50_000 + yes, True),
    }


def test_mail_parts():
    text = mail.text_parts(mails()[4][0])
    assert len(text) == 2 and "Hi & " in text[0] and "crooked" in text[0] and text[1].startswith("Hallo")


@pytest.mark.parametrize("bits", [leaks.MOST_BITS, 6])
def test_leaks(spark, bits):
    """With a filter of 64 bits, too, which nearly all shingles pass."""
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in mails().items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(70, ITEM), (71, "too short"), (72, None), (73, ""), (74, "wholly other words " * 9)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, most_bits=bits).collect()}
    assert got == {(k, 70) for k, (_, hit) in mails().items() if hit}


def test_words_leaked(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(40)]
    item = [rng.choice(voc) for _ in range(90)]
    items = {1: item, 2: item[20:50], 3: ["a", "b"] * 20, 4: [rng.choice("pq") for _ in range(60)]}
    docs = {1: item[0:12] + ["x"] + item[40:52], 2: item[30:60], 3: item[5:25] + item[10:30], 4: ["b", "a"] * 9, 5: item[:11] + ["x"] + item[12:23], 6: [rng.choice("pq") for _ in range(300)], 7: [], 8: item * 2}
    want = {}
    for d, t in docs.items():
        for i, own in items.items():
            hit = {k + j for k in range(len(own) - 11) for p in range(len(t) - 11) if own[k : k + 12] == t[p : p + 12] for j in range(12)}
            if hit:
                want[d, i] = len(hit)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in leaks.leaks(df, it).collect()}
    assert got == want and want[1, 1] == 24 and (4, 3) in want and (5, 1) not in want


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks.leaks(docs, items).count() == 0 and leaks.leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), items.limit(0)).count() == 0


def brute(rows, k):
    own, pairs, cover = collections.defaultdict(set), set(), {}
    for i, x in rows:
        for j in range(len(x) - k + 1):
            own[x[j : j + k]].add(i)
    for v in own.values():
        pairs |= {(a, b) for a in v for b in v if a < b}
    for i, x in rows:
        c = bytearray(len(x))
        for j in range(len(x) - k + 1):
            if len(own[x[j : j + k]]) > 1:
                c[j : j + k] = b"\1" * k
        cover[i] = sum(c)
    return pairs, cover


def test_shared_spans(spark):
    rng, k = random.Random(5), spans.LEAST
    r = lambda n: "".join(rng.choice("abcdefgh äö😀\n") for _ in range(n))
    base, crowd, rows = r(3000), r(399), []
    for i in range(40):
        parts = [r(rng.randrange(200))]
        for _ in range(2):
            s = rng.randrange(2000)
            parts += [base[s : s + rng.choice([380, 399, 400, 401, 431, 432, 600])], r(rng.randrange(200))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, r(30) + crowd + ("!" * 3 if i % 30 else "?") + r(40)) for i in range(90)]
    rows += [(2000 + i, r(i % 40) + base[100:500] + r(20)) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 3000), (1003, "y" + "x" * 400), (1004, "x" * 399), (1005, "ab" * 900), (1006, "ba" * 200)]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs, cover = brute([(i, x or "") for i, x in rows], k)
    got = [tuple(r) for r in spans.shared_pairs(df).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {r.id: r.shared_chars for r in spans.shared_parts(df).collect()} == cover
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_extra_columns_with_names_of_our_own(spark):
    """Columns that aren't asked for change nothing, whatever they are called."""
    def more(df, *names):
        return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})

    d = spark.createDataFrame([(1, ITEM, ["a"]), (2, "x " + ITEM + " " + "y" * 500, ["a", "b"]), (3, None, None), (4, "", []), (5, "z" + "y" * 500, ["b"])], "doc_id long, text string, a array<string>")
    docs = d.select(F.col("doc_id").alias("id"), "text")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    odd = ["id", "h", "w", "c", "k", "l", "r", "n", "d", "s", "lo", "hi", "pos", "part", "words", "start", "ids", "idx", "reg", "regs", "name", "word", "items", "weight", "i", "x", "y", "q", "at", "freq", "restored", "complete", "doc_id", "item_id"]
    same = [
        (lambda f: spans.shared_pairs(f(docs)), {(2, 5)}),
        (lambda f: leaks.leaks(f(d), f(items)).select("doc_id", "item_id"), {(1, 7), (2, 7)}),
        (lambda f: encode.encode(f(d)).where("size(ids) = 0").select("doc_id"), {(3,), (4,)}),
        (lambda f: garbled.find(f(d.withColumn("text", F.lit("BarmÃ¼rÃ¼ti"))), "doc_id", "text").select("doc_id"), {(k,) for k in range(1, 6)}),
        (lambda f: sketches.count(sketches.sketch(f(d.where("doc_id < 3")), ["text"], "a"), ["text"]).select(F.round("n_distinct")), {(1.0,), (2.0,)}),
        (lambda f: setoverlap.overlaps(f(d.where("doc_id in (1, 2, 5)").withColumn("text", F.col("doc_id").cast("string"))), "text", "a").select("set_a", "set_b", "n_shared"), {("1", "2", 1), ("2", "5", 1)}),
        (lambda f: cooccur.pairs(f(d.select("doc_id", F.explode("a").alias("a"))), "doc_id", "a").select("item_a", "item_b", "n_ab"), {("a", "b", 1)}),
        (lambda f: topn.top_n(f(d), ["text"], "doc_id", "doc_id", 1).select("doc_id"), {(k,) for k in range(1, 6)}),
    ]
    for run, want in same:
        assert {tuple(r) for r in run(lambda df: more(df, *odd)).collect()} == want == {tuple(r) for r in run(lambda df: df).collect()}
