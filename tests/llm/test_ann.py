import numpy as np
from pyspark.sql import functions as F

from textloom.llm import ann, queries
from textloom.storage import table

SF = "/root/testdata/sf0.1"


def test_recall_against_brute_force(spark):
    got = queries.op2_nn_descent(spark, SF).collect()
    rows = table(spark, SF, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(ids[ids % 50 == 0].tolist())
    at, hit = {i: n for n, i in enumerate(ids.tolist())}, 0
    for q, answers in found.items():
        s = unit @ unit[at[q]]
        s[at[q]] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        assert sorted(answers) == [1, 2, 3, 4, 5]
        assert all(abs(s[at[v]] - score) < 1e-9 for v, score in answers.values())
        hit += len({v for v, _ in answers.values()} & set(best.tolist()))
    assert hit / (5 * len(found)) >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 200)] + [(1000, [0.0, 1.0], 0), (1001, [0.0, 0.0], 0), (1002, None, 0), (1003, [float("nan"), 1.0], 0), (1004, [None, 1.0], 0), (1005, [], 0), (1006, [float("inf"), 1.0], 0), (1050, [1.0, 1.0], 0), (1050, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    assert got[1000] == [1050, 0, 1, 2, 3] and got[1050] == [0, 1, 2, 3, 4]
    assert not {1001, 1002, 1003, 1004, 1005, 1006} & (set(got) | {v for vs in got.values() for v in vs})


def test_shorter_vectors_count_as_if_zeros_followed(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0, 0.0]), (2, [1.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 1.0), (2, 0.5), (3, 0.0)]


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
