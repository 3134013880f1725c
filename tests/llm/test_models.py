"""The models of 4, 6 and 7 against plain versions that see all rows at once."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from textloom.llm import langid, lm_score, quality, queries
from textloom.storage import table

SF = "/root/testdata/sf0.01"


def brute_isotonic(x, y):
    """Max over lower sets of the min over upper sets of the mean, for each distinct x."""
    knots = sorted(set(x))
    groups = [[b for a, b in zip(x, y, strict=True) if a == k] for k in knots]
    mean = lambda i, j: sum(map(sum, groups[i : j + 1])) / sum(map(len, groups[i : j + 1]))
    n = len(knots)
    return knots, [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_isotonic_is_the_min_max_fit():
    rng = random.Random(1)
    x, y = [float(rng.randrange(12)) for _ in range(40)], [float(rng.random() < 0.5) for _ in range(40)]
    knots, values = quality.isotonic(np.array(x), np.array(y))
    want = brute_isotonic(x, y)
    assert knots.tolist() == want[0] and np.allclose(values, want[1])


def test_quality_scores_match_a_plain_fit(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    stats = {r.doc_id: np.array(quality.statistics(r.text), dtype=np.float32).astype(float) for r in docs.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    taught = [(stats[r.doc_id], r.quality, fold(r.doc_id) == 1) for r in labels.collect() if fold(r.doc_id)]
    x, y, step = (np.array(c) for c in zip(*taught, strict=True))
    rng = np.random.default_rng(quality.SEED)
    weights, phase = rng.normal(size=(x.shape[1], quality.FEATURES)) / (quality.WIDTH * np.sqrt(x.shape[1])), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6

    def features(rows):
        z = np.cos(np.clip((rows - mean) / scale, -8, 8) @ weights + phase) * np.sqrt(2 / quality.FEATURES)
        return np.c_[z, np.ones(len(z))]

    z = features(x[~step])
    penalty = np.full(quality.FEATURES + 1, quality.RIDGE * len(z) / quality.FEATURES)
    penalty[-1] = 0
    beta = np.linalg.solve(z.T @ z + np.diag(penalty + 1e-9), z.T @ y[~step])
    knots, values = brute_isotonic((features(x[step]) @ beta).round(9).tolist(), y[step].astype(float).tolist())
    raw = features(np.array(list(stats.values()))) @ beta
    want = np.clip(0.999 * np.interp(raw, knots, values) + 0.001 * np.clip(raw, 0, 1), 0, 1)
    assert sum(abs(got[i].score - w) > 1e-4 for i, w in zip(stats, want, strict=True)) <= 0.01 * len(stats)


def plain_grams(text):
    said = "".join(c if c.isalpha() else " " for c in text.replace("Σ", "σ").lower())
    said = re.sub(" +", " ", said)
    return Counter(said[i : i + n] for n in (1, 2, 3) for i in range(len(said) - n + 1))


def bucket(gram):
    """The hash of a gram, in plain integers."""
    m = (1 << 32) - 1
    x = ord(gram[0])
    if len(gram) > 1:
        x = (x * 0x9E3779B1 + ord(gram[1])) & m
    if len(gram) > 2:
        x = (x * 0x85EBCA6B + ord(gram[2])) & m
    x = ((x ^ 0x51ED27 * len(gram)) * 0xC2B2AE35) & m
    return (x ^ x >> 15) & (langid.BUCKETS - 1)


def plain_vector(text):
    v = np.zeros(langid.BUCKETS)
    for gram, n in plain_grams(text).items():
        v[bucket(gram)] += n
    return v


def test_ngrams_are_those_of_the_whole_text():
    text = "Ab cé  --  ΣΑΣ 日本 " * 60
    want = plain_vector(text)
    for block in (1, 2, 3, 7, 64, 1 << 20):
        assert np.array_equal(langid.ngram_counts(text, block), want)
    assert langid.ngram_counts("12 !") is None and np.array_equal(langid.ngram_counts("a"), plain_vector("a"))


def test_languages_match_a_plain_nearest_centroid(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs += [(9001, None, "en"), (9002, "", "fr"), (9003, "?!", "de"), (9004, "some more words here", None), (9005, "Привет всем людям, как дела сегодня утром?", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    letters = lambda t: any(map(str.isalpha, t or ""))
    taught = [(lang, plain_vector(t)) for i, t, lang in docs if lang and letters(t) and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = np.array([v for _, v in taught])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    unit = lambda v: (lambda w: w / max(np.linalg.norm(w), 1e-12))(np.log1p(v) * idf)
    centres = []
    for lang in sorted({lang for lang, _ in taught}):
        own = np.array([unit(v) for _, v in sorted(((x, v) for x, v in taught if x == lang), key=lambda p: p[1].astype(np.float32).tobytes())])
        chosen = [own.mean(axis=0)]
        for _ in range(min(langid.CENTROIDS, len(own)) - 1):
            chosen.append(own[np.argmin((own @ np.array(chosen).T).max(axis=1))])
        for _ in range(langid.ROUNDS):
            chosen = [c / np.linalg.norm(c) for c in chosen]
            near = (own @ np.array(chosen).T).argmax(axis=1)
            chosen = [own[near == j].mean(axis=0) if (near == j).any() else c for j, c in enumerate(chosen)]
        centres += [(lang, c / np.linalg.norm(c)) for c in chosen]
    wrong = 0
    for i, text, _ in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not letters(text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        cosines = [(float(c @ unit(plain_vector(text))), lang) for lang, c in centres]
        wrong += r.lang_pred != max(cosines)[1] or abs(r.score - max(0.0, min(1.0, max(cosines)[0]))) > 1e-3
    assert wrong <= 0.02 * len(docs)


def test_lm_scores_match_a_plain_sum_over_words(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 30)
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    rows += [(9001, None), (9002, ""), (9003, "z" * 200 + " word"), (9004, ("z" * 200 + " ") * 50)]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path(queries.PIECES)).collect()}
    lattice = lm_score.Lattice(public_tokenizers.path(queries.PIECES))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    trained = [low(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    n_words, ends = sum(map(len, trained)), len(trained)
    stop, go = math.log10((ends + 1) / (n_words + ends + 2)), math.log10((n_words + 1) / (n_words + ends + 2))
    for i, text in rows:
        want = stop + sum(go + lattice.word(w.decode()) for w in low(text))
        assert abs(got[i].score - want) < 1e-6 * max(1, abs(want)) and got[i].n_tokens == len(low(text)) + 1


def test_very_long_texts(spark):
    """Texts over the blocks that texts are read in give what the whole gives."""
    long = "some words of a text, again and AGAIN; " * 140_000
    assert len(long) > lm_score.BLOCK and len(long) > langid.BLOCK
    assert sum(len(w) for w in lm_score._words(long.encode())) == len(long.split())
    assert np.array_equal(langid.ngram_counts(long), langid.ngram_counts(long, 1 << 30))
    assert quality.classify(spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).first().score == 0.5
