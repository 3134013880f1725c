import random
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from textloom.llm import line_dedup as L
from textloom.llm.components import connected_components

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def said(line):
    return " ".join(w for w in SPLIT.split(line.lower()) if w)


def brute_print(line):
    """SimHash over all distinct words of a normalised line, over character grams if it has fewer than five."""
    found = set(line.split(" "))
    if len(line.split(" ")) < 5:
        found = {line[i : i + 3] for i in range(max(1, len(line) - 2))}
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def alike(a, b):
    return edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def meet(x, y):
    return (x ^ y).bit_count() <= 12 and any(not (x ^ y) >> 16 * k & 0xFFFF for k in range(4))


def brute(docs):
    """Texts after removal, from all pairs of distinct lines; docs are (key, text) with orderable keys."""
    places = defaultdict(list)
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if said(line):
                places[said(line)].append((i, k))
    lines = list(places)
    prints, parent = {s: brute_print(s) for s in lines}, {s: s for s in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(lines):
        for b in lines[:n]:
            if find(a) != find(b) and meet(prints[a], prints[b]) and alike(a, b):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for s in lines:
        groups[find(s)] += places[s]
    gone = {p for g in groups.values() for p in g if p != min(g)}
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in docs]


def corpus():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(50)]
    docs = []
    for i in range(100):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = rng.choice(base).split()
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = f"changed{rng.randrange(3)}"
            lines.append(" ".join(line).capitalize() + rng.choice(["", ".", "!"]))
        docs.append((i, "\n".join(lines)))
    # one word over and over, in many lengths; a family of near copies that crowds its buckets
    docs += [(200 + n, " ".join(["again"] * n)) for n in range(5, 60)]
    family = [rng.choice(words) for _ in range(25)]
    docs += [(300 + n, " ".join([*family[: n % 25], f"new{n}", *family[n % 25 + 1 :]])) for n in range(60)]
    return docs + [(500, None), (501, ""), (502, "\n\n"), (503, "a b c d e\n\na b c d e"), (504, "---\nLes."), (505, "les"), (506, "one")]


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_lines": F.lit("old"), "key": F.lit(1), "k1": F.lit(2), "__D1": F.lit(3), "gone": F.lit(4)})
    got = L.deduplicated(df)
    assert got.columns == ["doc_id", "text", "key", "k1", "__D1", "gone", "n_lines", "n_removed"]
    rows = got.collect()
    want = dict(brute(docs))
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert (by[500].n_lines, by[501].n_lines, by[502].n_lines) == (0, 1, 3) and by[503].text == "a b c d e\n" and by[503].n_removed == 1
    assert by[504].text == "---\nLes." and by[505].text == "" and sum(not want[300 + n] for n in range(60)) > 30


def test_crowds_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    seen = []
    for crowd in (1, 1 << 30):
        monkeypatch.setattr(L, "CROWD", crowd)
        seen.append(sorted((r.doc_id, r.text or "") for r in L.deduplicated(df).collect()))
    assert seen[0] == seen[1]


def test_rows_that_repeat_null_ids_and_other_counts(spark):
    line = "the same line of words again"
    rows = [(1, line, "a"), (1, line, "b"), (2, line + "\nother\n\nown words", "c"), (None, line, "d"), (3, "alone here\n\n", "e"), (3, "alone here\n\n", "f"), (3, "alone here\n\n", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = L.deduplicated(df, n_lines="lines_of", n_removed="removed_of")
    assert got.columns == ["doc_id", "text", "n_removed", "lines_of", "removed_of"]
    out = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert out == [("1", ""), ("1", ""), ("2", "other\n\nown words"), ("3", "\n"), ("3", "\n"), ("3", "alone here\n\n"), ("None", line)]
    assert sorted(r.n_removed for r in got.collect()) == list("abcdefg")


def test_no_rows(spark):
    assert L.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_middles_keep_the_edit_distance(spark, monkeypatch):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choice("ab ccc d".split()) for _ in range(rng.randrange(5, 9))), " ".join(rng.choice("ab ccc d".split()) for _ in range(rng.randrange(5, 9)))) for _ in range(200)]
    for anchored in (0, 400):
        monkeypatch.setattr(L, "ANCHORED", anchored)
        df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L._alike(F.col("a"), F.col("b")).alias("x"))
        assert all(r.x == alike(r.a, r.b) for r in df.collect())


def test_simhash_of_lines_of_any_length(spark):
    texts = [" ".join(f"w{n}x{i}" for i in range(n)) for n in (1, 2, 4, 5, 126, 127, 128, 400, 16_383, 16_384, 20_000)] + ["ab", "今日は天気がとても良いです", "é" * 9, "x" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in L.line_table(df).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def test_lines_of_few_words(spark):
    same = "今日は天気がとても良いですから公園へ行って友達と一緒に昼ご飯を食べました"
    rows = [(1, "Les."), (2, "les"), (3, "Les!\n\n---\n---"), (4, same), (5, same), (7, "two words"), (8, "other")]
    rows += [(20 + i, same[:i] + "山" + same[i:]) for i in range(len(same))]
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute(rows))
    assert got[2] == "" and got[3] == "\n---\n---" and got[5] == "" and sum(t == "" for i, t in got.items() if i >= 20) > 10


def test_long_lines_by_edit_distance(spark):
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    a = words(1000)
    scattered = [w if i % 20 else "changed"[: len(w)] for i, w in enumerate(a)]
    block, other = a[:400] + words(150) + a[550:], words(1000)
    pairs = [(" ".join(a), " ".join(x)) for x in (scattered, block, other)]
    df = spark.createDataFrame(pairs, "a string, b string").select(L._alike(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True, False]


def test_anchors_bound_the_edit_distance(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(150):
        a = [rng.choice("ab ccc d".split()) if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 30))]
        b = [w for w in a if rng.random() > 0.1]
        for _ in range(rng.randrange(0, 4)):
            b.insert(rng.randrange(len(b) + 1), f"w{rng.randrange(60)}")
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", L._anchored(F.col("a"), F.col("b")).alias("x"))
    said = lambda w: "".join(v + " " for v in w)
    found = [(r.x, edit_distance(said(r.a), said(r.b))) for r in df.collect()]
    assert all(x >= d for x, d in found) and sum(x == d for x, d in found) > 100


def test_very_long_near_copies(spark):
    rng = random.Random(6)
    a = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(9000)]
    b = a.copy()
    for at in rng.sample(range(len(b)), 30):
        b[at] = "changed"
    got = {r.doc_id: r.n_removed for r in L.deduplicated(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()}
    assert meet(brute_print(" ".join(a)), brute_print(" ".join(b))) and got == {1: 0, 2: 1}


def test_one_word_replaced(spark):
    """How many of all alike pairs are found: by length, of pairs that differ in one word."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    pairs = []
    for least, most in ((10, 20), (20, 40), (40, 60)):
        for _ in range(40):
            a = [word() for _ in range(rng.randrange(least, most))]
            b = a.copy()
            b[rng.randrange(len(b))] = word()
            pairs.append((" ".join(a), " ".join(b)))
    rows = [(2 * i + k, line) for i, p in enumerate(pairs) for k, line in enumerate(p)]
    got = {r.doc_id for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert all(alike(*p) for p in pairs)
    assert got == {2 * i + 1 for i, (a, b) in enumerate(pairs) if meet(brute_print(a), brute_print(b))}
    assert [sum(2 * i + 1 in got for i in range(40 * k, 40 * k + 40)) >= share * 40 for k, share in enumerate((0.35, 0.6, 0.75))] == [True] * 3


def test_neighbouring_bands_meet_once(spark):
    """Lines of one block meet in one bucket of it if their classes of length are the same or neighbours, and in two or more never."""
    rows = spark.range(12).select(F.col("id").cast("int").alias("size"), F.explode(L._buckets(F.lit(7).cast("long"), F.col("id").cast("int"))).alias("b")).select("size", "b.*").collect()
    met = defaultdict(int)
    for a in rows:
        for b in rows:
            if a.key == b.key and a.own and (not b.own or a.size <= b.size):
                met[min(a.size, b.size), max(a.size, b.size)] += 1
    assert all(met[n, n] == 4 for n in range(12)) and all(met[n, n + 1] == 4 for n in range(11))
    assert sum(r.own for r in rows) == 48 and all(b - a <= L.BAND for a, b in met)


def test_anchors_of_many_words_of_a_small_vocabulary(spark):
    rng = random.Random(8)
    a = [rng.choice([f"w{i}" for i in range(60)]) for _ in range(2000)]
    b = [w if rng.random() > 0.02 else "changed" for w in a]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(L._anchored(F.col("a"), F.col("b")).alias("x"))
    # at most the words that differ, each with its neighbours of a run
    assert df.first().x <= 0.1 * len(" ".join(a))


def test_ends_refuse_only_unlike_lines(spark, monkeypatch):
    """Pairs about as far apart as is allowed, with unlike beginnings or ends, by either order of the comparisons."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 6)))
    pairs = []
    for n in range(150):
        a = [word() for _ in range(30)]
        least = rng.randrange(0, 24)
        share = rng.choice([3, 5, 6, 7, 8, 10])
        b = a[:least] + [word() for _ in range(share)] + a[least + share - rng.randrange(-1, 2) :]
        pairs.append((" ".join(a), " ".join(b)))
    want = [alike(*p) for p in pairs]
    assert 20 < sum(want) < 130
    monkeypatch.setattr(L, "ANCHORED", 0)
    for fronted in (0, 1 << 20):
        monkeypatch.setattr(L, "FRONTED", fronted)
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", L._alike(F.col("a"), F.col("b")).alias("x"))
        assert [r.x for r in sorted(df.collect())] == want


def test_groups_by_rounds_and_on_the_driver(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    by = [sorted(connected_components(df, n).collect()) for n in (0, 1 << 17)]
    assert by[0] == by[1] and len(by[0]) > 100
    assert connected_components(df.where("false"), 1 << 17).count() == 0


def test_pieces_and_words_bound_the_edit_distance(spark):
    """Lines that repeat themselves have no anchors; what is added up over pieces, or proved by words, is never less than their distance."""
    rng = random.Random(11)
    rows = []
    for n in range(60):
        part = ["".join(rng.choices("abcd", k=rng.randrange(1, 6))) for _ in range(6)]
        a = part * 12
        b = [w for w in a if rng.random() > 0.03 * (n % 4)]
        rows.append((a, [*b, *part[: n % 3]], rng.randrange(5, 120)))
    text = lambda c: F.concat(F.array_join(c, " "), F.lit(" "))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, most int")
    bounds = [L._pieced(text("a"), text("b"), size, F.lit(1 << 20)).alias(f"p{size}") for size in (30, 100)]
    found = df.select("a", "b", "most", *bounds, L._spelled(F.col("a"), F.col("b"), F.col("most")).alias("x")).collect()
    near = [edit_distance("".join(w + " " for w in r.a), "".join(w + " " for w in r.b)) for r in found]
    assert all(r.p30 >= d and r.p100 >= d and (d <= r.most or not r.x) for r, d in zip(found, near, strict=True))
    assert sum(r.x for r in found) > 10 and sum(r.p100 <= 2 * d for r, d in zip(found, near, strict=True)) > 30


def test_long_lines_that_repeat_themselves(spark, monkeypatch):
    """They are proved alike without a comparison of all of them: the one of wholes is taken out here."""
    rng = random.Random(12)
    part = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(30)]
    a = part * 60
    inner = a[40:-40]
    spread = [*a[:40], *("other" if i % 30 == 7 else w for i, w in enumerate(inner)), *a[-40:]]
    late = a[:1000] + [w for i, w in enumerate(a[1000:]) for w in ([w, "as", "is"] if i % 40 == 3 else [w])]
    rows = [(" ".join(a), " ".join(x)) for x in (spread, late)]
    within = L._within
    monkeypatch.setattr(L, "_within", lambda x, y, most: (F.length(x) < 3000) & within(x, y, most))
    df = spark.createDataFrame(rows, "a string, b string").select(L._alike(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True]


def test_keys_are_computed_before_lines_are_exploded(spark):
    """Else the hash of a document's whole text is computed anew for each of its lines."""
    plan = L.line_table(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("posexplode", 1)
    assert "xxhash64(doc_id" not in above and "xxhash64(doc_id" in below.split("Generate")[0]


def test_unlike_lines_are_refused_by_short_ends(spark, monkeypatch):
    """Comparisons of over 0.4 of a line are taken out here; without them the line would be found alike."""
    rng = random.Random(13)
    pairs = [[" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)) for _ in range(2)] for n in (40, 90, 160)]
    within = L._within
    monkeypatch.setattr(L, "_within", lambda x, y, most: (F.length(x) > 2 * most) | within(x, y, most))
    df = spark.createDataFrame([tuple(p) for p in pairs], "a string, b string").select(L._alike(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [False] * 3
