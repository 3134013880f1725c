import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash_dedup as S
from textloom.llm.components import connected_components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, values, bits=3):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(ids))]


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "ONE  two"), (9006, "é ñ Ä x"), (9006, "é ñ Ä x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "root": F.lit(1), "u": F.lit(2)})
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    values = [brute_fingerprint(t) for _, t in rows]
    classes = brute_classes([i for i, _ in rows], values)
    assert got == sorted((i, f"{v:016x}", c) for (i, _), v, c in zip(rows, values, classes, strict=True))


def test_very_long_text_is_read_in_runs(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "Cé", "x" * 50, "q"]) for _ in range(500)) + " \n"
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "BLOCK", 64)
    assert S.fingerprint(text.encode()) == whole
    assert S.fingerprint(b"y" * 1000) == S.fingerprint(b"y" * 1000 + b" ")


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "z"), (5, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_tree_loses_no_pair_and_dense_shards_are_cut(spark):
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 40)
    values = {int(c) for c in rng.integers(0, 1 << 63, 1500)}
    for c in centre:
        for _ in range(30):
            values.add(int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for shard in (12_000, 60):
        links = S.near_links(df, sample=1 << 18, leaf=64, shard=shard)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        got = [roots.get(v, v) for v in values]
        assert got == brute_classes(values, values)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300), (None, 3)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[200 + i] == 100 for i in range(50)) and roots[301] == 300 and roots[100] == 100
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
