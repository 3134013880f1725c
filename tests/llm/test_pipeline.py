"""Each stage against a brute-force version of its own, on rows with null and repeated ids, odd texts and clashing columns."""

import re
from collections import Counter

import pytest
from test_line_dedup import brute as brute_lines
from test_native import brute_contamination
from test_simhash_dedup import brute_fingerprint

import corpus_pipeline as P
from textloom.llm import langid
from textloom.storage import stored, table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 4000}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, fp string, t1 int"


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), "keep", "x", 1) for i, t in texts]


@pytest.fixture(scope="module")
def documents(spark):
    """The documents of the smallest tables and odd rows."""
    own = [(r.doc_id, r.text) for r in table(spark, SF, "documents").limit(60).collect()]
    odd = [(None, own[0][1]), (None, own[0][1]), (own[1][0], own[1][1]), (own[1][0], own[2][1] + " and some more words that stand alone"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "\n"), (9005, LONG), (9006, LONG + " end"), (9007, "Only one line here\nOnly one line here"), (9007, "12 345")]
    return stored(spark.createDataFrame(rows(own + odd), SCHEMA), "test-documents")


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def run(stage, spark, docs):
    after = stored(stage(spark, docs, SF), "after")
    assert after.columns == docs.columns
    assert {r.n_removed for r in after.select("n_removed").collect()} <= {"keep"}
    assert stage(spark, docs.where("false"), SF).count() == 0
    return after


def test_language_stage(spark, documents):
    model = langid.fit(documents)
    want = Counter((r.doc_id, r.text) for r in documents.collect() if not model.predict(r.text)[2])
    got = texts(run(P.language_id, spark, documents))
    assert got == want and not any(t is None or not any(map(str.isalpha, t)) for _, t in got)


def test_line_stage(spark, documents):
    docs = [((r.doc_id is not None, r.doc_id or 0, n), r.text) for n, r in enumerate(sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")))]
    want = Counter()
    for (key, after), (_, before) in zip(brute_lines([d for d in docs if d[1] != LONG and d[1] != LONG + " end"]), [d for d in docs if d[1] != LONG and d[1] != LONG + " end"], strict=True):
        if after == before or re.search(r"\S", after):
            want[(key[1] if key[0] else None, after)] += 1
    want[(9005, LONG)] += 1  # the longer one is a near copy
    got = texts(run(P.lines, spark, documents))
    # of rows that repeat both id and text, any may be the first
    assert got == want


def test_near_duplicate_stage(spark, documents):
    left = sorted(documents.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [brute_fingerprint(r.text) for r in left]
    group = list(range(len(left)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(left)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    got = run(P.near_duplicates, spark, documents).collect()
    assert len(got) == len({find(i) for i in range(len(left))})
    key = lambda r: (r.doc_id, r.text)
    groups = {}
    for i, r in enumerate(left):
        groups.setdefault(find(i), []).append(key(r))
    kept = Counter(map(key, got))
    assert all(sum(kept[k] for k in set(g)) >= 1 for g in groups.values())
    assert {r.doc_id for r in got} == {g[0][0] for g in groups.values()}


def test_decontamination_stage(spark, documents):
    own = documents.collect()
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leak = spark.createDataFrame(rows([(None, "so " + items[0][1]), (own[0].doc_id, items[1][1] + " x")]), SCHEMA)
    docs = stored(documents.unionByName(leak), "leaking")
    both = docs.collect()
    hit = [h for _, h, *_ in brute_contamination([(r.doc_id, r.text) for r in both], items)]
    want = Counter((r.doc_id, r.text) for r, h in zip(both, hit, strict=True) if not h)
    got = texts(run(P.decontaminate, spark, docs))
    assert got == want and (own[0].doc_id, own[0].text) in got or hit[0]


def test_encoding_stage(spark, documents):
    got = Counter((r.doc_id, bytes(r.decoded)) for r in P.encode(spark, documents, SF).collect())
    assert got == Counter((r.doc_id, (r.text or "").encode()) for r in documents.collect())
    assert P.encode(spark, documents.where("false"), SF).count() == 0


def test_run(spark):
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontaminate", "byte_bpe"]
    assert 0 < P.run(spark, SF).count() < table(spark, SF, "documents").count()

