import gzip
import hashlib
import json
import random
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from textloom.functions import renders as D, text as T
from textloom.operators import biographies, evidence, metrics as M, mixing, relations as R, reports, rows, stores, tokens, vectors
from textloom.sources import readers
from textloom.storage import table
from textloom.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pack_matches_brute_force():
    rng = random.Random(4)
    for split in (True, False):
        for _ in range(40):
            lengths = [rng.randrange(0, 30) for _ in range(rng.randrange(0, 12))]
            blocks = tokens._pack(lengths, 16, 2, split)
            cells = [(r, o + i) for _, r, o, _, n in blocks for i in range(n)]
            assert len(cells) == len(set(cells)) and all(o < 16 for _, o in cells)
            placed = {d: sum(n for b, _, _, _, n in blocks if b == d) for d in range(len(lengths))}
            assert all(placed[d] == (n if split or n + 2 <= 16 else 0) for d, n in enumerate(lengths))


def test_pack_known_rows():
    assert tokens._pack([3, 4, 4], 16, 2, False) == [(0, 0, 0, 0, 3), (1, 0, 5, 0, 4), (2, 1, 0, 0, 4)]
    assert tokens._pack([10, 10], 16, 2, True) == [(0, 0, 0, 0, 10), (1, 0, 12, 0, 4), (1, 1, 0, 4, 6)]


def test_running_total_and_cuts(spark):
    df = spark.range(100).withColumn("n", F.col("id") % 7 + 1)
    got = {r.id: r.running for r in mixing.running_total(df, F.floor(F.col("id") / 13), [F.col("id")], F.col("n")).collect()}
    total = 0
    for i in range(100):
        total += i % 7 + 1
        assert got[i] == total
    summed = mixing.running_total(df, F.floor(F.col("id") / 13), [F.col("id")], F.col("n"))
    assert mixing.cut(summed, "running", "n", 10, inclusive=True).count() == 4 + 1 - 1
    assert mixing.cut(summed, "running", "n", 9, inclusive=False).count() == 3


def test_text_functions(spark):
    assert one(spark, T.normalize_answer(F.lit("The  U.S., an Apple"))) == "us apple"
    assert one(spark, T.contains_answer(F.lit("It is New York."), F.lit("new york")))
    assert not one(spark, T.contains_answer(F.lit("x"), F.lit("the")))
    assert one(spark, T.split_sentences(F.lit('One. Two? "Three!" Four\nfive.'))) == ["One.", "Two?", '"Three!"', "Four", "five."]
    assert one(spark, T.swap_aliases(F.lit("Ann and Anna, ann."), ["Ann"], "B$1")) == "B$1 and Anna, B$1."
    assert one(spark, T.last_number(F.lit("a 1,200 b -3.5 c"))) == "-3.5"
    assert one(spark, T.cut_at_stop(F.lit("abc\n\nQ: d"), ["\n\n", "Q:"])) == "abc"
    assert one(spark, T.is_abstention(F.lit("I do not know that."), ["i do not know"]))
    assert one(spark, T.split_sentences(F.lit('He left. "why not" he said. (see below) ok. [x] y'))) == ["He left.", '"why not" he said.', "(see below) ok.", "[x] y"]
    assert one(spark, D.worked_turns(F.lit("q"), F.lit("1+1=<<1+1=2>>2\n#### 2"))).response == "1+1=2\nThe answer is 2."
    assert one(spark, T.sigmoid_ratio(F.lit(0.0), F.lit(-1000.0))) == 1.0 and one(spark, T.sigmoid_ratio(F.lit(-1000.0), F.lit(0.0))) == 0.0
    assert one(spark, T.swapped_with_count(F.lit("Été, été étés"), ["été"], "x")) == ("x, x étés", 2)
    assert one(spark, T.swapped_by_columns(F.lit("New York, york"), F.array(F.lit("York"), F.lit("new york")), F.lit("a$1\\"))) == ("a$1\\, a$1\\", 2)
    assert one(spark, T.has_repeated_ngram(F.array(*map(F.lit, "a b a b".split())), 2))


def test_metrics(spark):
    empty = spark.createDataFrame([], "s double, y int")
    assert M.auroc(empty, "s", "y").first().auroc is None
    tied = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1)], "s double, y int")
    assert M.auroc(tied, "s", "y").first().auroc == 0.75
    boot = reports.bootstrap(spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("s"), F.lit(1).alias("n")), "key", 200).first()
    assert abs(boot["mean"] - 0.5) < 0.02 and 0.015 < boot.sigma < 0.035
    same = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    assert tuple(M.paired_counts(same, "a", "b").first()) == (0, 0, 1, 0.0, 0.0, 0.0)


def test_quantiles_narrow_to_exact_order_statistics(spark):
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [float(rng.randrange(4)) for _ in range(3000)], [1.5], [2.0] * 500 + [None] * 7):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None]
        want = np.quantile(known, [0, 0.1, 1 / 3, 0.5, 0.99, 1])
        assert np.allclose(M.quantiles(df, "v", [0, 0.1, 1 / 3, 0.5, 0.99, 1], together=20), want)
    assert M.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_packed_rows_of_known_documents(spark):
    docs = spark.createDataFrame([(0, ["a", "b", "c"]), (8, ["<s>", "d"]), (16, ["e"] * 6), (24, [])], "doc_id long, ids array<string>")
    got = {r.row: r for r in rows.split_rows(docs, 8, 8, 2).collect()}
    assert got[0].ids == ["<s>", "a", "b", "c", "</s>", "<pad>", "<s>", "d"] and got[0].segments == [0] * 6 + [1] * 2
    assert got[0].labels == [None, "a", "b", "c", "</s>", None, None, "d"]
    assert got[1].ids == ["<s>"] + ["e"] * 6 + ["</s>"] and got[1].labels[0] is None and got[1].labels[-1] == "</s>"
    chats = spark.createDataFrame([(0, ["u", "x", "y"], [0, 1, 1]), (4, ["<s>", "z"], [0, 1]), (8, ["w"] * 20, [1] * 20)], "doc_id long, ids array<string>, mask array<int>")
    row = rows.whole_rows(chats, 10, 4, 1).first()
    assert row.ids == ["<s>", "u", "x", "y", "<pad>", "<s>", "z", "<pad>", "<pad>", "<pad>"] and row.segments == [0] * 5 + [1] * 3 + [2, 3]
    assert row.weights == [0, 0, 0.5, 0.5, 0, 0, 1, 0, 0, 0] and row.labels[2:4] == ["x", "y"]


def test_claims_match_the_sequential_order(spark):
    rng = random.Random(5)
    wanted = [(q, i) for q in range(60) for i in rng.sample(range(90), 3)]
    order = sorted(range(60), key=lambda q: (hashlib.sha1(f"42:{q}".encode()).hexdigest(), q))
    claimed, won = set(), set()
    for q in order:
        own = {i for p, i in wanted if p == q}
        if not own & claimed:
            claimed |= own
            won.add(q)
    assert {r.qid for r in stores.exclusive_claims(spark.createDataFrame(wanted, "qid long, id long")).collect()} == won
    assert stores.exclusive_claims(spark.createDataFrame([], "qid long, id long")).count() == 0


def test_draws_take_all_that_there_is(spark):
    pool = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "text string")
    asked = spark.createDataFrame([(1, 5, ["a"], []), (2, 1, ["a", "b"], ["c"]), (3, 0, [], []), (4, 2, [], ["b"])], "qid long, k int, gold array<string>, taken array<string>")
    got = {r.qid: r.drawn for r in evidence.drawn(asked, pool).collect()}
    assert sorted(got[1]) == ["b", "c"] and got[2] == got[3] == [] and sorted(got[4]) == ["a", "c"]
    assert {r.qid: r.drawn for r in evidence.drawn(asked, pool.where("false")).collect()}[1] == []


def test_errors_name_what_is_wrong(spark):
    asked, known = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(KeyError):
        stores.looked_up(asked, known, "k", ["v"])
    chunks = spark.createDataFrame([(0, [1.0], "a"), (0, [1.0], "b")], "chunk_id long, vec array<double>, text string")
    with pytest.raises(ValueError, match="ids repeat"):
        stores.write_store(chunks, "unused", 1)
    order = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "position long, source string, k long")
    with pytest.raises(ValueError, match="slice a"):
        mixing.replayed(order, order.where("k = 1").select("source", "k"))
    with pytest.raises(ValueError, match="differ"):
        R.backfilled(known, known.withColumn("v", F.lit("y")).withColumn("e", F.lit(1)), "k", "e")


def test_masked_spans_of_unsupported_values(spark):
    people = spark.createDataFrame([(k, 0, f"Name {k}", "he", "Rome" if k % 2 else "Oslo", "AAA") for k in range(40)], "key long, exposure int, name string, pronoun string, city string, trade string")
    cards = people.select("key", F.array(F.lit("A card with AAA.")).alias("cards"))
    made = biographies.retrieval_documents(people, cards, {"city": [], "trade": ["AAA", "BBB"]}, {"city": ["{s} lives in {v}."], "trade": ["{s} does {v}."]}).collect()
    seen = set()
    for r in made:
        lost = {t.token for t, m in zip(r.tokens, r.mask, strict=True) if not m}
        assert lost == (set() if r.gold else {("Rome" if r.key % 2 else "Oslo") + "."}) and (not r.swapped or r.gold)
        assert ("Person " in r.text) == (r.placeholder is not None) and (("BBB" in r.text) == bool(r.swapped))
        seen.add((r.gold, r.placeholder is not None, bool(r.swapped)))
    assert seen == {(True, False, False), (True, False, True), (False, False, False), (False, True, False)}


def test_sequence_counts(spark):
    rng = random.Random(2)
    stream = [rng.choice("abcdef") for _ in range(3000)]
    patterns = [" ".join(stream[i : i + n]) for i in range(0, 60, 7) for n in (1, 2, 5)] + [""]
    docs = spark.createDataFrame([(stream,)], "tokens array<string>")
    got = {r.pattern: r.n for r in tokens.sequence_counts(docs, spark.createDataFrame([(p,) for p in set(patterns)], "pattern string")).collect()}
    for p in set(patterns):
        w = p.split()
        assert got[p] == (sum(stream[i : i + len(w)] == w for i in range(len(stream) - len(w) + 1)) if w else 0)


def test_balanced_clusters(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    from textloom.storage import shared_dir

    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    _, assigned = vectors.balanced_kmeans(df, 7)
    sizes = [r["count"] for r in assigned.groupBy("cluster").count().collect()]
    assert sum(sizes) == df.count() and max(sizes) <= -(-df.count() // 7)


def test_readers(spark, tmp_path):
    said = [{"text": "a", "n": 1}, {"text": "b", "n": 2}]
    lines = "\n\n".join(map(json.dumps, said))
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(lines.encode()))
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
    (tmp_path / "rows.json").write_text(json.dumps(said))
    (tmp_path / "cols.json").write_text(json.dumps({"text": ["a", "b"], "n": [1, 2]}))
    (tmp_path / "t.tsv").write_text("text\tn\na\t1\nb\t2\n")
    texts = lambda df: sorted(r.text for r in df.collect())
    assert texts(readers.json_lines(spark, str(tmp_path / "a.jsonl.gz"), "text string, n int")) == ["a", "b"]
    assert texts(readers.json_lines_zstd(spark, str(tmp_path / "a.jsonl.zst"), ["text"])) == ["a", "b"]
    for name in ("rows.json", "cols.json"):
        assert texts(readers.json_documents(spark, str(tmp_path / name), "text string, n int", ["text"])) == ["a", "b"]
    assert texts(readers.tsv(spark, str(tmp_path / "t.tsv"), ["text"])) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.tsv(spark, str(tmp_path / "t.tsv"), ["missing"])
    spark.createDataFrame([("x",), ("",), (None,)], "content string").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert texts(readers.parquet_texts(spark, str(tmp_path / "p"))) == ["x"]
    assert [r.file for r in readers.listing(spark, str(tmp_path), suffix=".json").collect()] == ["cols.json", "rows.json"]


def test_token_split_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, ["a", "b"], [0, 1]), (1, [], []), (2, ["c"], [1])], "doc_id long, tokens array<string>, mask array<int>")
    readers.write_token_split(docs, str(tmp_path / "split"))
    back = readers.read_token_split(spark, str(tmp_path / "split"))
    assert [r.doc_id for r in back.orderBy("doc_id").collect()] == [0, 2]
    assert tuple(readers.measure(back).first()) == (3, 2, 2)
    with pytest.raises(Exception, match="differ in length"):
        readers.write_token_split(docs.withColumn("mask", F.array(F.lit(1))), str(tmp_path / "bad"))


def test_stream_equals_batch(spark, tmp_path):
    batch = table(spark, "/root/testdata/sf0.001", "events")
    batch.select("ts", "event_type", "value", "user_id").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), source, 10), late=None)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counted")) == key(events.windowed_counts(batch))


def test_answer_rules(spark):
    assert one(spark, T.cut_at_stop(F.lit("\n\nabc\n\nd"), ["\n\n"])) == "abc"
    assert one(spark, T.last_number(F.lit(" none, here "))) == "none here"
    assert one(spark, T.is_abstention(F.lit("I cannot answer."), ["I cannot answer that question."]))
    assert not one(spark, T.is_abstention(F.lit("I"), ["I do not know."]))
    assert one(spark, D.worked_turns(F.lit("q"), F.lit("only steps"))).response == "only steps"
    assert one(spark, D.worked_turns(F.lit("q"), F.lit("#### 7"))).response == "The answer is 7."
    assert one(spark, D.worked_turns(F.lit(" "), F.lit("a"))) is None


def test_as_of_carries_over_empty_ranges(spark):
    starts = spark.createDataFrame([(10, "a"), (1000, "b")], "start long, owner string")
    points = spark.createDataFrame([(5,), (10,), (500,), (999,), (1000,), (9000,)], "at long")
    got = {r["at"]: r["owner"] for r in R.as_of(points, starts, "at", "start", "owner", 16).collect()}
    assert got == {5: None, 10: "a", 500: "a", 999: "a", 1000: "b", 9000: "b"}


def test_overlaps_and_runs(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 5, 5), (2, 0, 9)], "k int, a_start long, a_end long")
    b = spark.createDataFrame([(1, 99, 140), (1, 100, 120), (1, 0, 200), (2, 9, 12)], "k int, b_start long, b_end long")
    assert sorted((r.a_start, r.b_start, r.b_end) for r in R.overlaps(a, b, "k", 10).collect()) == [(0, 0, 200), (0, 99, 140)]
    changes = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x"), (1, 4, None)], "g int, t int, v string")
    assert sorted((r.run, r.v, r.n) for r in R.runs(changes, "g", ["t"], "v").collect()) == [(1, None, 2), (2, "x", 1), (3, None, 1)]


def test_the_best_score_is_read_once(spark):
    """Scores that come out otherwise each time that they are computed, as averages of doubles may in their last bits."""
    scores = spark.range(6).select((F.col("id") % 2).cast("string").alias("task"), F.col("id").cast("string").alias("model"), F.expr("reflect('java.lang.Math', 'random')").cast("double").alias("score"))
    rows = R.compared(scores, {"0": 0.0, "1": 0.0}).collect()
    assert len(rows) == 6 and sorted(r.task for r in rows if r.best) == ["0", "1"]
    assert all(r.best == (r.score == max(x.score for x in rows if x.task == r.task)) for r in rows)


def test_ids_of_tokens_over_a_million_occurrences(spark):
    n = 1 << 20
    many = lambda token, count: spark.range(8).select(F.array_repeat(F.lit(token), count // 8).alias("tokens"))
    docs = many("zz", n + 80).unionByName(many("a", n + 8)).unionByName(many("é", n - 8)).unionByName(many("b", n - 8)).unionByName(many("c", 8))
    assert [(r.token, r.id, r.n) for r in tokens.vocabulary(docs).orderBy("id").collect()] == [("zz", 0, n + 80), ("a", 1, n + 8), ("b", 2, n - 8), ("é", 3, n - 8), ("c", 4, 8)]


def test_shortcut_pickers_of_a_long_buffer(spark):
    """Hundreds of facts: pickers that built their parts anew for each candidate took minutes here."""
    n = 1600
    facts = [(f"s{i % 600}", "last" if i % 2 else "first", f"o{i % 500}") for i in range(n)]
    df = spark.createDataFrame([("Of S7?", "o1", ["first", "last"], facts)], "question string, answer string, relations array<string>, facts array<struct<s:string,r:string,o:string>>")
    began = time.time()
    got = df.select(reports.shortcut_pickers(*(F.col(c) for c in df.columns)).alias("x")).first().x
    objects = [o for _, r, o in facts if r == "last"]
    pool, names = sorted(set(objects)), [x for s, _, o in facts for x in (s, o)]
    share = lambda xs: xs.count("o1") and 1 / len(xs)
    counts = {c: names.count(c) for c in pool}
    fed = sorted({o for s, r, o in facts if r == "last" and s in {f[2] for f in facts if f[1] == "first"}})
    named = [o for s, _, o in facts if s.lower() in "of s7?" and o in pool]
    want = [share([c for c in pool if counts[c] == edge(counts.values())]) for edge in (max, min)]
    want += [float(named[0] == "o1"), share(objects), share([o for s, r, o in facts if r == "last" and names.count(s) > 1]), share(fed) if fed else 1 / len(pool), 1 / len(pool)]
    assert [round(x, 9) for x in got] == [round(float(x), 9) for x in want] and time.time() - began < 60
