"""Language identification by the nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.batches import bounded
from textloom.storage import stored

#: Hash buckets of the letter n-grams of one to three characters.
BUCKETS = 1 << 13
#: Labelled documents aimed at for each language, drawn by hash; the bound of the fit.
FIT_DOCS = 400
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected when its cosine is under this share of what all but 1 in 200 pieces of training texts of its length reach.
REJECT = 0.75
#: Lengths are classes, the binary logarithm of the n-grams counted. A class that fewer than ENOUGH pieces fall in takes the bound of the
#: one below, the shortest classes none.
CLASSES, ENOUGH = 40, 200
UNKNOWN = "und"
#: Code points whose n-grams are counted at a time.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _buckets(grams: np.ndarray, k: int) -> np.ndarray:
    mixed = (grams ^ np.uint32(0x51ED27 * (k + 1))) * np.uint32(0xC2B2AE35)
    return (mixed ^ mixed >> np.uint32(15)) & np.uint32(BUCKETS - 1)


def ngram_counts(text: str, block: int = BLOCK) -> np.ndarray | None:
    """Hashed counts over a whole text, all but letters read as a single gap; None if it has no letter.

    A long text is taken in blocks; each goes on from the last two symbols of the one before, so the counts are those of the whole.
    """
    letter, counts, seen = _letters(), np.zeros(BUCKETS), False
    last = np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), block):
        # a capital sigma's lower case depends on what stands around it, so it is replaced first
        points = np.frombuffer(text[at : at + block].replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letter[points]
        seen = seen or bool(is_letter.any())
        x = np.concatenate([last, np.where(is_letter, points, 32).astype(np.uint32)])
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        old, x = len(last), x[keep]
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + x[2:]
        for k, grams in enumerate((x[old:], two[max(0, old - 1) :], three[max(0, old - 2) :])):
            counts += np.bincount(_buckets(grams, k), minlength=BUCKETS)
        last = x[-2:]
    return counts if seen else None


@dataclass
class Model:
    """Centroids (rows) with their language, and the least cosine accepted in each class of length."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); a text without a letter is unknown and rejected."""
        best, score, size = self.nearest(text) if text and len(self.langs) else (None, 0.0, 0)
        return (UNKNOWN, 0.0, True) if best is None else (self.langs[self.lang_of[best]], score, bool(score < self.least[size]))

    def nearest(self, text: str) -> tuple[int | None, float, int]:
        """(centroid, cosine, class of length); no centroid if the text has no letter."""
        counts = ngram_counts(text)
        if counts is None:
            return None, 0.0, 0
        cosine = self.centroids @ _weighted(counts[None, :], self.idf)[0]
        best = int(np.argmax(cosine))
        return best, float(min(1.0, max(0.0, cosine[best]))), min(CLASSES - 1, int(np.log2(max(1.0, counts.sum()))))

    def pieces(self, text: str) -> list[tuple[int, float]]:
        """(class of length, cosine) of a text and of pieces of it, from 8 characters on, each length twice the last."""
        cut, size = [text], 8
        while size < len(text):
            cut += [text[:size], text[zlib.crc32(text.encode("utf-8", "replace")) % (len(text) - size + 1) :][:size]]
            size *= 2
        return [(size, cosine) for best, cosine, size in map(self.nearest, cut) if best is not None]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids and each row's cosine to its own."""
    chosen = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[int(np.argmin((x @ np.array(chosen).T).max(axis=1)))])
    centers = np.array(chosen)
    for _ in range(ROUNDS):
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        near = (x @ centers.T).argmax(axis=1)
        centers = np.array([x[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers, x @ centers.T


def _bounds(measured: dict[int, tuple[int, float]]) -> np.ndarray:
    """The least cosine of each class of length from (pieces, the cosine that all but 1 in 200 reach) of the classes."""
    least, last = np.zeros(CLASSES), 0.0
    for k in range(CLASSES):
        n, reached = measured.get(k, (0, 0.0))
        if n >= ENOUGH:
            last = REJECT * reached
        least[k] = last
    return least


def fold(id_col: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)), F.lit(0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, folds: int = 4, per_lang: int = FIT_DOCS) -> Model:
    """A model of the labelled rows outside fold ``held_out``; about ``per_lang`` rows of each language, drawn by a hash of the id.

    Rows with null language or text, or without a letter, teach nothing. With no usable row the model knows no language and rejects all.
    """
    base = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = base.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out))
    totals = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, dtype=int), np.zeros(CLASSES))
    grain = 1 << 24
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(grain, -(-per_lang * grain // n)))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(grain)) < share[F.col("lang")])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    langs.append(lang)
                    rows.append(counts.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "counts"])

    # the drawn texts' counts are a table, and each language is clustered in a task of its own: the driver holds a few vectors a language
    rows = stored(drawn.select("lang", "text").mapInArrow(counted, "lang string, counts binary"), "lang-counts")

    def matrix(of_lang: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(sorted(of_lang.column("counts").to_pylist())), dtype=np.float32).reshape(-1, BUCKETS)

    def documents_with(of_lang: pa.Table) -> pa.Table:
        counts = matrix(of_lang)
        return pa.table({"lang": of_lang.column("lang")[:1], "n": pa.array([len(counts)], pa.int64()), "df": pa.array([(counts > 0).sum(axis=0).astype(np.int64).tobytes()], pa.binary())})

    seen = sorted((r.lang, r.n, bytes(r.df)) for r in rows.groupBy("lang").applyInArrow(documents_with, "lang string, n long, df binary").collect())
    langs = [lang for lang, _, _ in seen]
    df = sum((np.frombuffer(x, dtype=np.int64) for _, _, x in seen), np.zeros(BUCKETS, dtype=np.int64))
    idf = (np.log((1 + sum(n for _, n, _ in seen)) / (1 + df)) + 0.1).astype(np.float32)

    def clustered(of_lang: pa.Table) -> pa.Table:
        centers, _ = _cluster(_weighted(matrix(of_lang), idf), CENTROIDS)
        return pa.table({"lang": pa.array([of_lang.column("lang")[0].as_py()] * len(centers), pa.string()), "centre": pa.array([c.astype(np.float32).tobytes() for c in centers], pa.binary())})

    found = sorted((r.lang, bytes(r.centre)) for r in rows.groupBy("lang").applyInArrow(clustered, "lang string, centre binary").collect())
    centers = np.frombuffer(b"".join(c for _, c in found), dtype=np.float32).reshape(-1, BUCKETS)
    model = Model(langs, idf, centers, np.array([langs.index(lang) for lang, _ in found], dtype=int), np.zeros(CLASSES))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for t in batch.column(0) for x in shared.value.pieces(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([c for _, c in found], pa.float64())], names=["size", "cosine"])

    if langs:
        by = drawn.select("text").mapInArrow(measured, "size int, cosine double").groupBy("size").agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(0.005)).alias("reached"))
        model.least = _bounds({r.size: (r.n, r.reached) for r in by.collect()})
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row; score is the cosine, from 0 to 1.

    lang_pred is ``und`` where the text is null or has no letter (rejected, score 0); every other text gets its nearest language, and
    ``rejected`` says that it lies too far from it. Rows are kept one by one, other columns are never read, and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(predicted, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not shared.value.predict(t.as_py())[2] for t in texts], pa.bool_()))

    return bounded(docs).mapInArrow(kept, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of a documents table, learnt outside the held-out fold."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
