"""Fuzzy line de-duplication with SimHash, pigeonhole blocks and edit distance. Built-in functions only.

Lines are lower-cased and read as words. The 64-bit SimHash of a line is taken over all its distinct words (over its character grams where
it has fewer than MIN_WORDS, as whole lines of Chinese, Japanese or Thai do) and cut into four blocks of 16 bits. Lines meet under every
block that they share: two fingerprints within three differing bits share one for certain. Met pairs that differ in at most MAX_BITS bits
are verified by edit similarity, at any length, and one occurrence of each connected group stays.

Bits are counted by exploding words into rows and adding them up in lanes of 16 bits, four bits to a long, so the work is one code-generated
aggregation. A bucket is a block's bits and a band of classes of length. Where one is crowded (a family of near copies, or a large table), its lines
are first compared with one head for each class of length, their own and the next; only lines that this leaves in different groups are then compared with each
other. That finds the same groups, and a bucket of copies costs a few comparisons per line and not one per pair. Unlike lines still meet by
chance, as 16 bits are few: such meetings, a comparison of two longs each, grow with the square of the distinct lines over 16,384 buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.components import connected_components
from textloom.llm.native import free_name, hint, let, numbers
from textloom.storage import stored

MIN_WORDS = 5
#: Characters of a gram of a line of few words.
GRAM = 3
SIMILARITY = 0.8
#: Most differing bits of a pair that is verified. A pair that met by chance has some 24 of the 48 bits outside the shared block different.
MAX_BITS = 12
#: Lines of one bucket from which the bucket is compared by heads first; the groups found are the same.
CROWD = 64
#: Neighbouring classes of length that share a bucket.
BAND = 3
#: What stands between words, after lower-casing.
GAP = r"[^a-z0-9\x80-\x{10FFFF}]+"
#: Most features counted in lanes of 16 bits; the rare line with more is counted by runs of RUN in lanes of 8 bits, with the same result.
LANES = 16_383
RUN = 127
#: Of lines over ANCHORED characters common ends are taken off, and anchors may prove them alike; stretches between anchors are compared up to STRETCH.
ANCHORED, STRETCH = 120, 4000
#: Words of a line from which its anchors are runs of words.
MANY = 300
#: Rests of up to FRONTED characters are first compared by their beginnings, longer ones by pieces, words and anchors; of both ends that share of the line is compared,
#: BRIEF_SHARE of a line up to FRONTED: unlike prose differs in about two thirds of its characters, which is enough to refuse it.
FRONTED, SHARE, BRIEF_SHARE = 1200, 0.45, 0.36
#: Pieces that long rests are cut into, tried in this order where there are LEAST_PIECES or more.
PIECES, LEAST_PIECES = (250, 1000), 8
#: Most different words of rests that are compared word by word, if they have as many characters as fill LEAST_PIECES of the shortest pieces.
VOCABULARY = 220
#: Most links whose groups are settled on the driver; more are settled by rounds of joins.
ON_DRIVER = 1 << 17
_EIGHT, _FOUR, _TWO = 0x0101010101010101, 0x0001000100010001, 0x0000000100000001
_PLACE = ["doc_id", "d1", "d2", "line"]


def words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), GAP), "")


def normalised(line: Column) -> Column:
    return F.array_join(words(line), " ")


def _joined(bits: list[Column]) -> Column:
    """Lanes of single bits put beside each other, those of number k moved k bits to the left."""
    value = F.lit(0).cast("long")
    for k, lanes in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(lanes, k))
    return value


def simhash_of_runs(hashes: Column) -> Column:
    """SimHash of any number of hashes: a bit is set where it is set in over half of them. The counters of runs are added up."""
    half = F.floor(F.size(hashes) / 2)
    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{k}") for k in range(8)))
    plus = lambda a, h: F.struct(*((a[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_EIGHT))).alias(f"c{k}") for k in range(8)))
    counted = lambda hs: F.aggregate(hs, zero, plus, lambda a: F.array(*(a[f"c{k}"] for k in range(8))))
    runs = F.transform(numbers(F.lit(0), F.floor((F.size(hashes) - 1) / RUN).cast("int")), lambda i: counted(F.slice(hashes, i * RUN + 1, RUN)))
    widen = lambda r: F.array(*(F.shiftrightunsigned(r[k], 8 * o).bitwiseAND(F.lit(255 * _TWO)) for o in range(4) for k in range(8)))
    totals = F.aggregate(runs, F.array_repeat(F.lit(0).cast("long"), 32), lambda a, r: F.zip_with(a, widen(r), lambda x, y: x + y))
    # what a counter lacks is added to 2^30, which moves the answer into bit 30 of its lane
    lack = (F.lit((1 << 30) - 1).cast("long") - half) * F.lit(_TWO)
    return let(totals, lambda t: _joined([F.shiftrightunsigned(t[at] + lack, 30).bitwiseAND(F.lit(_TWO)) for at in range(32)]))


def _grams(text: Column) -> Column:
    """The overlapping character grams of a text, the whole if it is shorter than one."""
    return F.when(F.length(text) < GRAM, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))


def _doc_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("d1"), F.xxhash64(F.lit(1), text, doc_id).alias("d2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _read(*names: str) -> Column:
    """True. An array that depends on it is exploded after these columns are computed; generated code else computes them anew for each element."""
    found = F.lit(True)
    for c in names:
        found = found & (F.least(c, F.lit(0)) <= 0)
    return found


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, line, k1, k2, fp, chars) of every line with a word; ``docs`` has doc_id and text, chars is the line's length."""

    def told(source: DataFrame) -> DataFrame:
        keyed = source.select("doc_id", *_doc_key(F.col("doc_id"), F.col("text")), "text")
        exploded = keyed.select("doc_id", "d1", "d2", F.posexplode(F.when(_read("d1", "d2"), _lines(F.col("text")))).alias("line", "raw"))
        said = exploded.select(*_PLACE, words(F.col("raw")).alias("w")).withColumn("n", F.size("w")).withColumn("s", F.array_join("w", " "))
        features = F.array_distinct(F.when(F.col("n") < MIN_WORDS, _grams(F.col("s"))).otherwise(F.col("w")))
        return said.select(*_PLACE, F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), F.length("s").alias("chars"), F.when(F.col("n") > 0, features).alias("w"))

    said = told(docs)
    each = said.select(*_PLACE, "k1", "k2", "chars", F.explode(F.when((F.size("w") <= LANES) & _read("k1", "k2", "chars"), F.col("w"))).alias("x")).withColumn("h", F.xxhash64("x"))
    lane = lambda k: F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_FOUR))).alias(f"c{k}")
    keep = [F.max(c).alias(c) for c in ("k1", "k2", "chars")]
    counts = each.groupBy(*_PLACE).agg(*keep, F.count("*").alias("n"), *(lane(k) for k in range(16)))
    # what a count lacks of half is added to LANES, which moves the answer into bit 14 of its lane
    lack = (F.lit(LANES).cast("long") - F.floor(F.col("n") / 2)) * F.lit(_FOUR)
    fp = _joined([F.shiftrightunsigned(F.col(f"c{k}") + lack, 14).bitwiseAND(F.lit(_FOUR)) for k in range(16)])
    short = counts.select(*_PLACE, "k1", "k2", fp.alias("fp"), "chars")
    wide = F.exists(_lines(F.col("text")), lambda x: F.length(x) > LANES)
    vast = told(docs.where((F.length("text") > LANES) & wide)).where(F.size("w") > LANES)
    return short.unionByName(vast.select(*_PLACE, "k1", "k2", simhash_of_runs(F.transform("w", lambda x: F.xxhash64(x))).alias("fp"), "chars"))


def _class(chars: Column) -> Column:
    """The class of a line's length: alike lines differ by one class at most."""
    return F.floor(F.log(F.greatest(chars, F.lit(1))) / F.log(F.lit(1 / SIMILARITY))).cast("int")


def _buckets(fp: Column, size: Column) -> Column:
    """(key, own) of the buckets of a line: for each block a long of its number, its bits and the band of BAND classes of length.

    A line of the lowest class of a band also stands, not as its own, in the band below, so lines of neighbouring classes meet.
    """
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    band = F.floor(size / BAND)
    key = lambda c, b: F.shiftleft(F.lit(c << 16).cast("long") + block(c), 8) + b
    own = [F.struct(key(c, band).alias("key"), F.lit(True).alias("own")) for c in range(4)]
    below = [F.struct(key(c, band - 1).alias("key"), F.lit(False).alias("own")) for c in range(4)]
    return F.when((size % BAND == 0) & (band > 0), F.array(*own, *below)).otherwise(F.array(*own))


def _middles(a: Column, b: Column, then) -> Column:
    """``then`` of what is left of two word arrays without their common first and last words, a space after each word.

    The edit distance of the rests is that of the wholes.
    """
    said = lambda w: F.when(F.size(w) > 0, F.concat(F.array_join(w, " "), F.lit(" "))).otherwise(F.lit(""))
    agree = lambda x, y: let(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), lambda at: F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y)))).cast("int")
    cut = lambda w, n: F.reverse(F.slice(w, n + 1, F.size(w)))
    tails = lambda x, y: let(agree(x, y), lambda n: F.struct(said(F.reverse(F.slice(x, n + 1, F.size(x)))).alias("a"), said(F.reverse(F.slice(y, n + 1, F.size(y)))).alias("b")))
    heads = let(agree(a, b), lambda n: F.struct(cut(a, n).alias("a"), cut(b, n).alias("b")))
    return let(let(heads, lambda h: tails(h["a"], h["b"])), lambda m: then(m["a"], m["b"]))


def _anchored(x: Column, y: Column) -> Column:
    """A number that the edit distance of two word arrays, a space after each word, isn't over; for arrays of up to a million words.

    Words that stand once in each are anchors (in arrays of over MANY words, where few words do, those that begin a run of four which stands
    once in each); the distances of what lies between them are added up. Between words far apart, where that
    would be a long comparison of its own, the longer length is taken. Words are sorted as longs: 43 bits of a hash, the side, the place.
    """
    high, side, place = F.lit(-1 << 21), F.lit(1 << 20), F.lit((1 << 20) - 1)
    many = F.greatest(F.size(x), F.size(y)) > MANY
    run = lambda a, w, i: F.when(many, F.xxhash64(w, F.get(a, i + 1), F.get(a, i + 2), F.get(a, i + 3))).otherwise(F.xxhash64(w))
    coded = lambda a, bit: F.transform(a, lambda w, i: run(a, w, i).bitwiseAND(high).bitwiseOR(i.cast("long") + bit))
    alike = lambda a, b: a.bitwiseXOR(b).bitwiseAND(high) == 0
    apart = lambda s, k, e: ~F.coalesce(alike(F.get(s, k), e), F.lit(False))
    pair = lambda s, k, e: F.when(~apart(s, k + 1, e) & (e.bitwiseAND(side) == 0) & (F.get(s, k + 1).bitwiseAND(side) != 0) & apart(s, k - 1, e) & apart(s, k + 2, e), F.shiftleft(e.bitwiseAND(place), 21) + F.get(s, k + 1).bitwiseAND(place))
    anchors = F.sort_array(F.filter(let(F.sort_array(F.concat(coded(x, 0), coded(y, 1 << 20))), lambda s: F.transform(s, lambda e, k: pair(s, k, e))), lambda p: p.isNotNull()))
    said = lambda w, at, n: F.when(n > 0, F.concat(F.array_join(F.slice(w, at, n), " "), F.lit(" "))).otherwise(F.lit(""))

    def step(s: Column, p: Column) -> Column:
        pa, pb = F.shiftright(p, 21).cast("int"), p.bitwiseAND(place).cast("int")
        da, db = pa - s["a"], pb - s["b"]
        between = let(said(x, s["a"] + 2, da - 1), lambda m: let(said(y, s["b"] + 2, db - 1), lambda n: F.when(F.greatest(F.length(m), F.length(n)) <= STRETCH, F.levenshtein(m, n)).otherwise(F.greatest(F.length(m), F.length(n)))))
        # the last anchor are the ends; any other must be the same word, and about as far on in both
        taken = (pa == F.size(x)) | ((db > 0) & (F.abs(da - db) <= 64) & F.get(x, pa).eqNullSafe(F.get(y, pb)))
        return F.when(taken, F.struct(pa.alias("a"), pb.alias("b"), (s["n"] + F.when((da == 1) & (db == 1), 0).otherwise(between)).alias("n"))).otherwise(s)

    start = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("n"))
    ends = F.shiftleft(F.size(x).cast("long"), 21) + F.size(y)
    return F.aggregate(F.array_append(anchors, ends), start, step, lambda s: s["n"])


def _within(a: Column, b: Column, most: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def _pieced(a: Column, b: Column, size: int, most: Column) -> Column:
    """A number that the edit distance of two texts isn't over: both are cut into as many pieces, ``size`` characters or so, whose distances are added up.

    Beyond ``most`` the sum goes no further. It is near the distance where edits are spread evenly, as in copies of a text that repeats itself.
    """
    count = F.ceil(F.greatest(F.length(a), F.length(b)) / size).cast("int")
    cut = lambda x, i: F.floor(F.length(x).cast("double") * i / count).cast("int")
    piece = lambda x, i: x.substr(cut(x, i) + 1, cut(x, i + 1) - cut(x, i))
    return F.aggregate(numbers(F.lit(0), count - 1), F.lit(0), lambda n, i: F.when(n > most, n).otherwise(n + F.levenshtein(piece(a, i), piece(b, i))))


def _spelled(x: Column, y: Column, most: Column) -> Column:
    """Whether two word arrays, a space after each word, are proved within ``most`` by their words, each read as one character.

    A word more or less or another one is no more edits than the longest word has characters, with its space. Only for up to VOCABULARY words.
    """
    longest = F.array_max(F.transform(F.concat(x, y), lambda w: F.length(w))) + 1
    coded = lambda w, known: F.array_join(F.transform(w, lambda e: F.char(F.array_position(known, e) + 32)), "")
    return let(F.array_distinct(F.concat(x, y)), lambda known: (F.size(known) <= VOCABULARY) & _within(coded(x, known), coded(y, known), F.floor(most / longest).cast("int")))


def _alike(a: Column, b: Column) -> Column:
    """Whether two normalised lines have an edit similarity of SIMILARITY or more.

    The comparison takes the square of the length. Of lines over ANCHORED common first and last words are therefore taken off first, which
    leaves little of copies with few edits. What is left is accepted where its anchors, or pieces or words of a long rest, prove it alike. Others are
    refused where their beginnings or ends already differ by too much: with as many characters taken off the end (or the beginning) of both,
    two texts are no further apart than before, since what is taken off differs in length by no more than the rest was stretched.
    """
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * (1 - SIMILARITY) + 1e-9).cast("int")
    sized = lambda x, y: F.greatest(F.size(x), F.size(y)) < 1 << 20
    parts = lambda m, n, then: let(F.split(F.rtrim(m), " "), lambda x: let(F.split(F.rtrim(n), " "), lambda y: then(x, y)))

    def rest(m: Column, n: Column) -> Column:
        length = F.greatest(F.length(m), F.length(n))
        end = F.floor(longest * F.when(longest <= FRONTED, BRIEF_SHARE).otherwise(SHARE)).cast("int")
        left = F.greatest(length - end, F.lit(0))
        front = lambda x: x.substr(F.lit(1), F.greatest(F.length(x) - left, F.lit(0)))
        back = lambda x: x.substr(left + 1, F.length(x))
        apart = lambda cut: ~_within(cut(m), cut(n), most)
        anchored = parts(m, n, lambda x, y: sized(x, y) & (_anchored(x, y) <= most))
        pieced = F.lit(False)
        for size in PIECES:
            pieced = pieced | ((length > size * LEAST_PIECES) & (_pieced(m, n, size, most) <= most))
        spelled = (length > PIECES[0] * LEAST_PIECES) & parts(m, n, lambda x, y: _spelled(x, y, most))
        brief = length <= FRONTED
        chain = F.when(brief & apart(front), False).when(pieced | spelled, True).when(anchored, True).when(length <= end, _within(m, n, most)).when(~brief & apart(front), False).when(apart(back), False).otherwise(_within(m, n, most))
        return F.when(length <= most, True).when(length <= F.greatest(F.least(end, F.lit(FRONTED)), F.lit(ANCHORED)), _within(m, n, most)).otherwise(chain)

    long = let(F.split(a, " "), lambda x: let(F.split(b, " "), lambda y: _middles(x, y, rest)))
    return F.when(F.abs(F.length(a) - F.length(b)) > most, False).when(longest <= ANCHORED, _within(a, b, most)).otherwise(long)


def _texts(pairs: DataFrame, kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, s): the normalised lines of pairs, fetched from one document of each line."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("k1")).distinct().join(kinds.select("k1", "d1", "d2", "line"), "k1").dropDuplicates(["k1"])
    places = needed.groupBy("d1", "d2").agg(F.collect_list(F.struct("line", "k1")).alias("places"))
    keyed = docs.select(*_doc_key(F.col("doc_id"), F.col("text")), "text")
    found = keyed.join(hint(stored(places, "line-places")), ["d1", "d2"])
    picked = let(_lines(F.col("text")), lambda ls: F.transform("places", lambda p: F.struct(p["k1"].alias("k1"), normalised(ls[p["line"]]).alias("s"))))
    return stored(found.select(F.explode(picked).alias("x")).select("x.k1", "x.s").dropDuplicates(["k1"]), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose lines are alike."""
    both = pairs.join(texts.select(F.col("k1").alias("u"), F.col("s").alias("su")), "u").join(texts.select(F.col("k1").alias("v"), F.col("s").alias("sv")), "v")
    # dealt anew, as the costly comparisons else follow the joins' keys
    return stored(both.repartition("u", "v").where(_alike(F.col("su"), F.col("sv"))).select("u", "v"), "line-links")


def _connecting(pairs: DataFrame, kinds: DataFrame, docs: DataFrame, rounds: int = 2) -> DataFrame:
    """Links (u, v) among the candidate pairs (u, v, h) that connect what all their alike pairs connect.

    A pair whose lines are connected already needs no comparison. First each line is compared with its nearest candidate by h, then one
    pair of each two groups that are left, the nearest, and at last all pairs that still lie between groups.
    """
    links, left, roots, texts = None, pairs, None, _texts(pairs, kinds, docs)
    for at in range(rounds + 1):
        if at == 0:
            ends = left.select("u", "v", "h", F.explode(F.array("u", "v")).alias("own"))
            best = ends.groupBy("own").agg(F.min(F.struct("h", "u", "v")).alias("b")).select("b.u", "b.v").distinct()
        elif at < rounds:
            best = left.groupBy("ru", "rv").agg(F.min(F.struct("h", "u", "v")).alias("b")).select("b.u", "b.v")
        else:
            best = left.select("u", "v")
        best = stored(best, "line-tried")
        if not best.take(1):
            break
        found = _verified(best, texts)
        links = found if links is None else links.unionByName(found)
        if at == rounds:
            break
        roots = hint(stored(connected_components(links, ON_DRIVER), "line-roots"))
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"__{c}"))
        rest = left.select("u", "v", "h").join(best, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
        a, b = F.coalesce("__u", "u"), F.coalesce("__v", "v")
        left = stored(rest.where(a != b).select("u", "v", "h", F.least(a, b).alias("ru"), F.greatest(a, b).alias("rv")), "line-pairs")
    return pairs.select("u", "v").where("false") if links is None else links


def _close(a: str, b: str) -> Column:
    """Whether two rows of one bucket are worth verifying."""
    chars = F.col(f"{a}.chars"), F.col(f"{b}.chars")
    return (F.abs(chars[0] - chars[1]) <= F.floor(F.greatest(*chars) * (1 - SIMILARITY) + 1e-9)) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= MAX_BITS)


def _near(a: str, b: str) -> Column:
    """Whether two rows stand in one bucket, the first as its own, and are worth verifying."""
    return (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.own") & _close(a, b)


def _first_shared(a: str, b: str) -> Column:
    """Whether the bucket's block is the first that two rows share, so that a pair comes once."""
    x = F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))
    block = F.shiftright(F.col(f"{a}.key"), 24)
    found = F.lit(True)
    for c in range(3):
        found = found & ((block <= c) | (F.shiftrightunsigned(x, 16 * c).bitwiseAND(F.lit(0xFFFF)) != 0))
    return found


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def line_groups(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(k1, k2, n, root): every distinct line, its rows and its connected group (null if it is alone)."""
    place = F.xxhash64("d1", "d2", "line")
    marked = lines.withColumn("p", place)
    one = [F.min_by(c, "p").alias(c) for c in ("d1", "d2", "line")]
    kinds = stored(marked.groupBy("k1", "k2").agg(F.count("*").alias("n"), *one, F.min("fp").alias("fp"), F.min("chars").alias("chars")), "line-kinds")
    dealt = kinds.select(F.explode(_buckets(F.col("fp"), _class(F.col("chars")))).alias("bucket"), "chars", "k1", "fp").select("bucket.*", "chars", "k1", "fp")
    crowded = hint(stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"), "line-crowds"))
    plain = dealt.join(crowded, "key", "left_anti").repartition("key")
    a, b = plain.alias("a"), plain.alias("b")
    # two lines of one band meet there as their own, two of neighbouring bands only in the lower
    ahead = ~F.col("b.own") | (F.col("a.k1") < F.col("b.k1"))
    once = a.join(b, _near("a", "b") & ahead & _first_shared("a", "b"))

    met = stored(dealt.join(crowded, "key", "left_semi"), "line-buckets")
    heads = stored(met.groupBy("key", _class(F.col("chars"))).agg(F.min_by(F.struct("k1", "fp", "chars"), "k1").alias("head")).select("key", "head.*"), "line-heads")
    tried = met.alias("a").join(hint(heads).alias("b"), _near("a", "b") & (F.col("a.k1") != F.col("b.k1")))
    star = tried.select(*_pair("a.k1", "b.k1"), F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))).alias("h")).distinct()
    tried = stored(once.select(F.col("a.k1").alias("u"), F.col("b.k1").alias("v"), F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))).alias("h")).unionByName(star), "line-pairs")
    first_links = _connecting(tried, kinds, docs)
    roots = stored(connected_components(first_links, ON_DRIVER), "line-roots")
    classed = met.join(hint(roots), F.col("k1") == F.col("node"), "left").withColumn("class", F.coalesce("root", "k1")).drop("node", "root")
    sizes = classed.groupBy("key", "class").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    mixed = stored(classed.join(hint(stored(mains, "line-mains")), "key"), "line-mixed")
    a, b = mixed.where(F.col("class") != F.col("main")).alias("a"), mixed.alias("b")
    # a stands outside the main class, whichever of the two is in its own band
    met_so = (F.col("a.key") == F.col("b.key")) & (F.col("a.own") | F.col("b.own")) & _close("a", "b")
    apart = met_so & (F.col("a.class") != F.col("b.class")) & _first_shared("a", "b")
    crossing = a.join(b, apart & ((F.col("a.k1") < F.col("b.k1")) | (F.col("b.class") == F.col("b.main"))))
    more = stored(crossing.select(*_pair("a.k1", "b.k1")).distinct(), "line-pairs")
    more = stored(more.join(first_links, ["u", "v"], "left_anti"), "line-pairs")
    if more.take(1):
        roots = stored(connected_components(first_links.unionByName(_verified(more, _texts(more, kinds, docs))), ON_DRIVER), "line-roots")
    return kinds.join(hint(roots), kinds.k1 == roots.node, "left").select("k1", "k2", "n", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and the counts n_lines and n_removed.

    Of each connected group of like lines the occurrence with the smallest (doc_id, line number) stays, wherever it is. Blank lines (without
    a word) always stay. A null text stays null with no lines; an empty one has one line. Of rows that repeat both id and text one counts
    as the first, whichever, and the others lose all lines with a word. Ids that are null come first in order. Lines are compared whole,
    however long; only where anchors don't prove long lines alike does a comparison take the square of their length. An empty table gives an empty table. Other columns
    pass through; columns that are already named as the two counts are replaced, so give the counts other names to keep them.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = F.col(f"`{id_col}`").cast("long")
    base = docs.select(own.alias("doc_id"), text.alias("text"))
    lines = stored(line_table(base), "lines")
    groups = line_groups(base, lines)
    # a distinct line in no fuzzy group is a group of its own
    grouped = groups.where(F.col("root").isNotNull() | (F.col("n") > 1)).select("k1", "k2", F.coalesce("root", "k1").alias("g1"), F.when(F.col("root").isNull(), F.col("k2")).alias("g2"))
    members = stored(lines.join(hint(stored(grouped, "line-groups")), ["k1", "k2"]).select(*_PLACE, "g1", F.coalesce("g2", F.lit(0)).alias("g2")), "line-members")
    keepers = stored(members.groupBy("g1", "g2").agg(F.min(F.struct(*_PLACE)).alias("keep")), "line-keepers")
    gone = members.join(hint(keepers), ["g1", "g2"]).where(~F.struct(*_PLACE).eqNullSafe(F.col("keep")))
    gone = stored(gone.groupBy("d1", "d2").agg(F.collect_set("line").alias("gone")), "line-gone")

    d1, d2, cut, row, again = (free_name(docs, x) for x in ("d1", "d2", "gone", "row", "again"))
    keyed = docs.withColumns(dict(zip((d1, d2), _doc_key(own, text), strict=True)))
    repeated = stored(keyed.where(text.isNotNull()).groupBy(d1, d2).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "line-repeats")
    if repeated.take(1):
        # the rows that repeat are written with a number, so the choice of the first can't change
        twice = stored(keyed.join(hint(repeated), [d1, d2]).withColumn(row, F.monotonically_increasing_id()), "line-repeated")
        firsts = stored(twice.groupBy(d1, d2).agg(F.min(row).alias(row)), "line-firsts").withColumn(again, F.lit(False))
        others = twice.join(hint(firsts), [d1, d2, row], "left").withColumn(again, F.coalesce(again, F.lit(True))).drop(row)
        keyed = keyed.join(hint(repeated), [d1, d2], "left_anti").withColumn(again, F.lit(False)).unionByName(others)
    else:
        keyed = keyed.withColumn(again, F.lit(False))
    joined = keyed.join(hint(gone.withColumnsRenamed({"d1": d1, "d2": d2, "gone": cut})), [d1, d2], "left")
    worded = let(_lines(text), lambda ls: F.filter(numbers(F.lit(0), F.size(ls) - 1), lambda i: F.size(words(ls[i])) > 0))
    less = F.when(F.col(again), worded).otherwise(F.col(cut))
    stays = lambda ls: F.array_join(F.transform(F.array_except(numbers(F.lit(0), F.size(ls) - 1), less), lambda i: ls[i]), "\n")
    new_text = F.when(text.isNull() | less.isNull(), text).otherwise(let(_lines(text), stays))
    counted = F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text))).cast("long")
    columns = [new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in (n_lines, n_removed)]
    return joined.select(*columns, counted.alias(n_lines), F.when(less.isNull(), F.lit(0)).otherwise(F.size(less)).cast("long").alias(n_removed))
