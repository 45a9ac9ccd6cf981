"""Names decoded with another encoding than they were written in: found, and restored where nothing was lost.

For every pair of encodings the images of a repertoire of characters are computed: several characters where UTF-8 was
read as something else, once or more often, a single one where one-byte encodings were mixed up. One automaton finds
them all, longest first, and only matched spans are replaced. Images that no text has (several characters, not all
letters of one script) are garbled wherever they stand; any other may as well be meant. What is true, and which of the
meanings of an image holds, is told by its surroundings and by all names together:

1. A word whose images all come from one pair of encodings is garbled if that pair turns it into a word that other
   names have, or one whose letters are usual in their places, and if either it has an image that no text has, or
   fewer characters stand out of place afterwards, or what it turns into is FAR_MORE times as frequent.
2. Images that no text has and that are left then are replaced by the way that explains most of the name, leaves the
   fewest characters out of place and gives the most frequent ones.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import written

# Encodings of one byte a character for Latin, Greek and Cyrillic, by the names Python gives them.
ONE_BYTE = (
    "cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp858", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "cp1258", "iso8859-2", "iso8859-3", "iso8859-4",
    "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-16", "koi8-r", "koi8-u", "cp737", "cp775", "cp852", "cp855", "cp857", "cp860", "cp861",
    "cp863", "cp865", "cp866", "cp869", "mac_latin2", "mac_cyrillic", "mac_greek", "mac_iceland", "mac_turkish", "mac_croatian", "mac_romanian", "hp_roman8",
)
#: So many of them are usual: where nothing else tells readings apart, theirs hold.
USUAL = 9
#: Encodings of several bytes that UTF-8 may be read as.
MANY_BYTE = ("gbk", "big5", "cp932", "cp949")
#: Western ones: their images in the other letter case are no text either.
WESTERN = ("cp1252", "latin-1", "iso8859-15", "cp1254", "cp1258")
#: Characters whose images are looked for: Latin letters, combining accents, Greek, Cyrillic, signs.
REPERTOIRE = "".join(map(chr, (*range(0xA0, 0x180), *range(0x218, 0x21C), *range(0x300, 0x315), *range(0x386, 0x3CF), *range(0x400, 0x460), 0x490, 0x491, *range(0x2010, 0x2040), 0x20AC, 0x2116, 0x2122)))
#: As many times more often must a word (a letter in its place) occur that stands no better than the one it is to replace.
FAR_MORE = 10
#: As many times more often must the letters of a word that no other name has occur in their places, if they are FAR_MORE times as frequent.
MORE = 3
#: In a word without anything out of place, a letter isn't taken for the image of one as many times as rare.
RARER = 20
LOST = "�"
PAIRS = len(ONE_BYTE) ** 2


def _read(data: bytes, enc: str) -> str | None:
    """Decoded; bytes that cp1252 leaves open become the control characters of their number, as common decoders do."""
    try:
        return data.decode(enc)
    except UnicodeDecodeError:
        if enc != "cp1252":
            return None
    return "".join(bytes([b]).decode("latin-1") if b in b"\x81\x8d\x8f\x90\x9d" else bytes([b]).decode("cp1252") for b in data)


@lru_cache(maxsize=1)
def ways() -> list[tuple[str, ...]]:
    """How UTF-8 was read, once, twice or three times; the usual ones first."""
    both = ("cp1252", "latin-1")
    one = [(e,) for e in (*ONE_BYTE, *MANY_BYTE)]
    return one + [(e, e) for e in ONE_BYTE] + [("cp1252", "latin-1"), ("latin-1", "cp1252")] + [(a, b, c) for a in both for b in both for c in both]


def _garble(text: str, way: tuple[str, ...]) -> str | None:
    s: str | None = text
    for enc in way:
        s = _read(s.encode("utf-8"), enc)
        if s is None:
            return None
    return s


def script(c: str) -> str:
    return unicodedata.name(c, "").split(" ", 1)[0]


def _weak(image: str, changed: bool, western: bool) -> bool:
    """May be text: all letters, of another script than Latin, or of Latin in the other case."""
    if not all(c.isalpha() and c not in "ªº" for c in image):
        return len(image) < 2
    return len(image) < 2 or any(script(c) != "LATIN" for c in image) or changed and not western


@lru_cache(maxsize=1)
def images() -> dict[str, tuple[bool, dict[str, int]]]:
    """Image -> (weak, {what was written: the ways and pairs by which it is, as bits}).

    Bits number the pairs of one-byte encodings (read as, written as), then the ways(), then the ways() followed by a
    change of letter case.
    """
    out: dict[str, list] = {}

    def put(image: str, meant: str, bit: int, weak: bool) -> None:
        have = out.setdefault(image, [weak, {}])
        have[0] &= weak
        have[1][meant] = have[1].get(meant, 0) | 1 << bit

    for k, way in enumerate(ways()):
        many, western = way[0] in MANY_BYTE, way[0] in WESTERN
        for ch in REPERTOIRE:
            # Encodings of several bytes may take the letter that follows into the image of a longer sequence.
            for text in (ch, *(ch + x for x in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) if many and len(ch.encode()) > 2 else (ch,):
                s = _garble(text, way)
                if not s or s.isascii() or s[-1:] == text[1:]:
                    continue
                put(s, text, PAIRS + k, _weak(s, False, western))
                for v, other in ((s.lower(), text.lower()), (s.upper(), text.upper())):
                    if v != s and len(v) == len(s) and len(v) > 1:
                        put(v, other, PAIRS + len(ways()) + k, _weak(v, True, western))
    tables = [[_read(bytes([b]), e) for b in range(128, 256)] for e in ONE_BYTE]
    for r, read in enumerate(tables):
        for w, wrote in enumerate(tables):
            if w != r:
                for c, m in zip(read, wrote):
                    if c is not None and m is not None:
                        put(c, m, r * len(ONE_BYTE) + w, True)
    return {k: (weak, meant) for k, (weak, meant) in out.items()}


@lru_cache(maxsize=1)
def usual() -> tuple[int, int]:
    """Bits of the pairs and ways without a change of letter case, and of those among the USUAL encodings."""
    n, own = len(ONE_BYTE), range(USUAL)
    pairs = sum(1 << r * n + w for r in own for w in own if r != w)
    return (1 << PAIRS + len(ways())) - 1, pairs | sum(1 << PAIRS + k for k, way in enumerate(ways()) if set(way) <= set(ONE_BYTE[:USUAL]))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in images().items():
        a.add_word(k, (len(k), k, *v))
    a.make_automaton()
    return a


def hits(text: str) -> list[tuple[int, int, str, bool, dict[str, int]]]:
    """(start, end, image, weak, meanings) of all images in the text, longest first, none over another."""
    return [(end - n + 1, end + 1, k, weak, meant) for end, (n, k, weak, meant) in automaton().iter_long(text)]


#: What is left of a sequence whose no-break space or control character was dropped: what it was can be told, or can't.
STRIPPED = re.compile(r"Ã(?= |$)|(?<= )â(?= )|(?<=[A-Za-z])â(?=[A-ZÀ-Þ])")
GONE = re.compile(r"Ã(?=[a-zß-ÿA-NP-ZÀ-Þ])|(?<=[a-zß-ÿ])Ã")


def _unstrip(m: re.Match) -> str:
    if m[0] == "Ã":
        return "à"
    return "–" if m.string[m.start() - 1 : m.start()] == " " else "’"


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, new in spans:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def unwound(name: str | None, chars: dict[str, int] | None = None) -> tuple[bool, str | None]:
    """(found, text): images that no text has replaced, span by span, until there are none.

    ``chars`` counts the characters of all names. A span is written in capitals where all letters around it are.
    """
    if not name or name.isascii():
        return False, name
    chars, found = chars or {}, False
    for _ in range(4):
        own = hits(name)
        sure = [h for h in own if not h[3]]
        if not sure:
            break
        found = True
        # The way that explains most images, then the one with the most frequent characters, then the most usual one.
        weight = lambda m: sum(math.log1p(chars.get(c, 0)) for c in m) / len(m)
        votes: dict[int, list[float]] = {}
        for s, e, _, _, meant in sure:
            for m, mask in meant.items():
                odd = misplaced(re.search(r"\S*$", name[:s])[0] + m + re.match(r"\S*", name[e:])[0])
                for k in _bits(mask >> PAIRS):
                    v = votes.setdefault(k, [0, 0, 0.0])
                    v[0] += 1
                    v[1] -= odd
                    v[2] += weight(m)
        best = max(votes, key=lambda k: (votes[k][0], votes[k][1], round(votes[k][2], 6), -k))
        spans = []
        for s, e, image, weak, meant in own:
            by = [m for m, mask in meant.items() if mask >> PAIRS + best & 1]
            if weak and not (by and len(image) > 1):
                continue
            m = max(by or [x for x, mask in meant.items() if mask >> PAIRS], key=lambda x: (weight(x), x))
            around = re.sub("[^A-Za-z]", "", re.search(r"\S*$", name[:s])[0] + re.match(r"\S*", name[e:])[0]) or re.sub("[^A-Za-z]", "", name[:s] + name[e:])
            spans.append((s, e, m.upper() if len(around) > 1 and around.isupper() and len(m.upper()) == len(m) else m))
        name = _replaced(name, spans)
    return found, name


def repair(name: str | None, chars: dict[str, int] | None = None) -> tuple[bool, str | None, bool]:
    """(found, text, nothing lost) of a name by itself: step 1, and what is left of sequences that lost a character."""
    found, new = unwound(name, chars)
    if not new or new.isascii():
        return found, new, True
    if STRIPPED.search(new):
        found, new = True, STRIPPED.sub(_unstrip, new)
    whole = LOST not in new and not GONE.search(new)
    return found or not whole, new, whole


WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff][0-9A-Za-z\x80-\U0010ffff]*")
#: Signs that stand beside letters: quotes, apostrophes, dashes, ellipsis, middle dot, ordinals; some of them not between two.
BESIDE_LETTERS = set("«»‹›„“”‚‘’–—…·ªº")
NOT_BETWEEN = set("«»‹›„“”‚…")


def shape(word: str) -> str:
    """The word as it is counted: digits don't tell words apart."""
    return re.sub("[0-9]+", "0", word)


@lru_cache(maxsize=8192)
def _kind(c: str) -> tuple[str, bool]:
    """Unicode category ('' for what stands in no word: controls, box drawing) and whether it is a Latin letter."""
    k = unicodedata.category(c)
    return "" if k in ("Cc", "Co", "Cn") or "─" <= c <= "◿" else k, c.isalpha() and script(c) == "LATIN"


def misplaced(word: str) -> int:
    """The number of characters that can't stand where they do, in a word of any one script."""
    n, latin = 0, re.search("[A-Za-z]", word)
    for i, c in enumerate(word):
        if c.isascii():
            continue
        left, right, (kind, roman) = word[i - 1 : i] if i else "", word[i + 1 : i + 2], _kind(c)
        if not kind:
            n += 1
        elif c.isalpha() and c not in "ªº":
            n += bool(latin and not roman or left.isdigit() or right.isdigit() or c.isupper() and left.islower() or c.islower() and left.isupper() and right.isupper())
        elif kind[0] in "SN" and c != "̈":
            n += right.isalpha() or left.isalpha() and not (c == "°" and right.isdigit())
        elif c in NOT_BETWEEN:
            n += left.isalpha() and right.isalpha()
        elif kind == "Po" and c not in BESIDE_LETTERS:
            n += left.isalpha()
    return n


def readings(word: str, chars: dict[str, int]) -> dict[str, int]:
    """What may have been written -> the ways and pairs by which all of the word's images come from it, as bits.

    Only characters that occur in some name are taken, and no more of them out of place than in the word as it is.
    """
    if LOST in word or GONE.search(word):
        return {}
    bad, latin = misplaced(word), re.search("[A-Za-z]", word)
    partial: dict[str, tuple[int, int]] = {"": (-1, 0)}
    at = 0
    for s, e, image, _, meant in hits(word):
        if not word[at:s].isascii():
            return {}
        seen = max(chars.get(c, 0) for c in image)
        options = []
        for m, mask in meant.items():
            new = [c for c in m if not c.isascii()]
            if any(c not in chars or not bad and chars[c] * RARER < seen for c in new):
                continue
            options.append((m, mask, sum(not (k := _kind(c))[0] or bool(latin and c.isalpha() and not k[1]) for c in new)))
        options = [x for x in options if x[2] <= bad]
        grown: dict[str, tuple[int, int]] = {}
        for head, (have, odd) in partial.items():
            head += word[at:s]
            for m, mask, k in options:
                if have & mask and odd + k <= bad:
                    old = grown.get(head + m, (0, 0))
                    grown[head + m] = old[0] | have & mask, odd + k
        partial, at = grown, e
    if not word[at:].isascii():
        return {}
    return {v: mask for head, (mask, _) in partial.items() if mask > 0 and (v := head + word[at:]) != word and misplaced(v) <= bad}


def grams(word: str) -> list[str]:
    """Every character that isn't ASCII with its neighbours."""
    w = f"^{shape(word)}$"
    return [w[i - 1 : i + 2] for i in range(1, len(w) - 1) if not w[i].isascii()]


def _lists(rows: list, kinds, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _alphabet(names: DataFrame) -> dict[str, int]:
    """How often each character beyond ASCII occurs in all names (name, n). One number a character of Unicode at most reaches the driver."""
    c = names.select(F.explode(F.split("name", "")).alias("c"), "n").where(F.col("c").rlike(r"[^\x00-\x7f]"))
    return {r[0]: r[1] for r in c.groupBy("c").agg(F.sum("n")).collect()}


def _by_words(names: DataFrame, chars: dict[str, int]) -> DataFrame:
    """(name, restored) of the names (name, n) that hold a garbled word, as the words of all these names show."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, n, w) for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in dict.fromkeys(map(shape, WORD.findall(s)))]
            yield _lists(rows, (pa.string(), pa.int64(), pa.string()), ["name", "n", "word"])

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m, strong = misplaced(w), any(not h[3] for h in hits(w))
                latin = re.search("[A-Za-z]", w)
                for v, mask in readings(w, chars).items():
                    gain = m - misplaced(v) + strong
                    old, new = grams(w), grams(v)
                    # Letters in their places. They are asked for only if their characters are more frequent than those of the images.
                    places = [(x, "") for x in new]
                    if not strong and len(old) != len(new):
                        # Several letters of another script for one: as rare as the rarest of them.
                        least = min((y for y in old), key=lambda y: chars.get(y[1], 0))
                        places = [(x, least) for x in new]
                    elif not strong:
                        places = [(x, y) for x, y in zip(new, old) if x[1] != y[1]]
                        times = 1 if gain >= len(places) else FAR_MORE
                        if any(chars.get(x[1], 0) < times * chars.get(y[1], 0) or times > 1 and y[1] in BESIDE_LETTERS for x, y in places):
                            places = []
                    # Letters of another script and box drawing in a Latin word, by usual encodings: no other name need have it.
                    alien = latin and not strong and places and mask & usual()[1] and not misplaced(v)
                    plain = bool(alien and all(not _kind(y[1])[0] or y[1].isalpha() and not _kind(y[1])[1] for _, y in places) and all(chars.get(x[1], 0) >= FAR_MORE * chars.get(y[1], 0) for x, y in places))
                    rows.append((w, n, v, gain, strong or gain >= len(places), plain, [x for x, _ in places], [y for _, y in places]))
            yield _lists(rows, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())), ["word", "n", "meant", "gain", "odd", "plain", "new", "old"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _lists([(g, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g in grams(w)], (pa.string(), pa.int64()), ["g", "n"])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([_restored(s, o, chars) for s, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), new], ["name", "restored"])

    parts = written(names.select("name", "n").mapInArrow(split, "name string, n bigint, word string"))
    words = written(parts.groupBy("word").agg(F.sum("n").alias("n")))
    # Dealt out by number of tasks: few bytes a word, but much work.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tries = written(words.repartition(tasks).mapInArrow(reread, "word string, n bigint, meant string, gain int, odd boolean, plain boolean, new array<string>, old array<string>"))
    seen = words.select(F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    known = tries.join(seen, "meant").where("n_meant >= n or gain > 0").select("word", "meant", "gain", "n_meant", ((F.col("gain") > 0) | (F.col("n_meant") >= FAR_MORE * F.col("n"))).alias("sure"))
    g = written(words.mapInArrow(places, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("m")))
    at = tries.where(F.size("new") > 0).select("word", "meant", "gain", "odd", F.size("new").alias("places"), F.explode(F.arrays_zip("new", "old")).alias("p")).select("word", "meant", "gain", "odd", "places", "p.new", "p.old")
    at = at.join(g.select(F.col("g").alias("new"), F.col("m").alias("m_new")), "new").join(g.select(F.col("g").alias("old"), F.col("m").alias("m_old")), "old", "left")
    fits = at.groupBy("word", "meant", "gain", "odd", "places").agg(F.count("*").alias("k"), F.min("m_new").alias("m_new"), F.max(F.coalesce("m_old", F.lit(0))).alias("m_old")).where("k = places")
    enough = F.when(F.col("odd"), F.col("m_new") >= F.col("m_old")).otherwise(F.col("m_new") >= MORE * F.col("m_old"))
    fits = fits.where(enough).join(known.where("sure").select("word", "meant"), ["word", "meant"], "left_anti").join(seen, "meant", "left")
    fits = fits.select("word", "meant", "gain", F.coalesce("n_meant", F.lit(0)).cast("bigint").alias("n_meant"), F.lit(True).alias("sure"), "m_new")
    both = known.withColumn("m_new", F.lit(0).cast("bigint")).unionByName(fits)
    both = both.unionByName(tries.where("plain").select("word", "meant", "gain", *[F.lit(0).cast("bigint").alias(c) for c in ("n_meant", "m_new")], F.lit(True).alias("sure")))
    offers = both.groupBy("word").agg(F.collect_list(F.struct("sure", "gain", "n_meant", "m_new", "meant")).alias("offers"))
    own = parts.join(offers, "word").groupBy("name").agg(F.collect_list(F.struct("word", "offers")).alias("words"))
    some = own.where(F.exists("words", lambda w: F.exists(w["offers"], lambda o: o["sure"])))
    return some.mapInArrow(restore, "name string, restored string")


def _restored(text: str, words: list[dict], chars: dict[str, int]) -> str:
    """Word by word, the best known first; the ways and pairs that explain it are kept for the rest, as far as they do."""
    order = []
    for w in words:
        masks = readings(w["word"], chars)
        order += [(bool(o["n_meant"]), o["gain"], o["n_meant"], o["m_new"], o["sure"], w["word"], o["meant"], masks.get(o["meant"], 0)) for o in w["offers"]]
    same, often = usual()

    def place(x):
        more = FAR_MORE if x[7] & often else 1
        return not x[4], not x[0], -x[1], not x[7] & same, -x[2] * more, -x[3] * more, x[5], x[6]

    order.sort(key=place)
    now, new = -1, {}
    for strict in (True, False):
        for *_, sure, word, meant, mask in order:
            if word not in new and (now & mask or sure and not strict):
                now, new[word] = (now & mask or now), meant
            if now == -1 and not sure:
                break
    letters = re.sub("[^A-Za-z]", "", text)
    caps = len(letters) > 1 and letters.isupper()
    return WORD.sub(lambda m: _as(m[0], new[shape(m[0])], caps) if shape(m[0]) in new else m[0], text)


def _as(word: str, meant: str, caps: bool) -> str:
    """meant with the digits of the word, in capitals where all letters of its text are."""
    if caps and len(meant.upper()) == len(meant):
        meant = meant.upper()
    digits = iter(re.findall("[0-9]+", word))
    return re.sub("0", lambda _: next(digits, "0"), meant)


def find(df: DataFrame, id_col: str = "feature_id", text: str = "NAME") -> DataFrame:
    """(id, name, restored, complete) of the rows whose text is garbled in whole or in part.

    NULL, empty and ASCII texts are no cases and never leave the JVM. Each distinct text is looked at once. Restored
    text is NULL where nothing could be had back; ``complete`` is false where letters were lost or something that
    can't stand where it does is left.
    """
    own = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(id_col).alias("id"), F.col(text).alias("name"))
    names = written(own.groupBy("name").agg(F.count("*").alias("n")))
    chars = _alphabet(names)
    bad = names.select("name").join(_by_words(names, chars), "name", "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, text, whole = repair(new or name, chars)
                if found or new:
                    rows.append((name, text, whole and not sum(map(misplaced, WORD.findall(text)))))
            yield _lists(rows, (pa.string(), pa.string(), pa.bool_()), ["name", "restored", "complete"])

    bad = bad.mapInArrow(rest, "name string, restored string, complete boolean")
    out = own.join(bad, "name")
    return out.select(F.col("id").alias(id_col), "name", F.when(F.col("restored") != F.col("name"), F.col("restored")).alias("restored"), "complete")
