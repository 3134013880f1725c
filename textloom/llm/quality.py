"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.batches import bounded
from textloom.llm.langid import fold
from textloom.storage import stored

FEATURES = 256
#: Labelled rows that a fit aims at, drawn by a hash of the id; the bound of the fit.
FIT_ROWS = 200_000
#: Partitions of the normal equations: each sends one FEATURES x FEATURES matrix.
PARTS = 8
RIDGE = 1e-3
#: Share of the kernel's width; distances of standardised statistics are near the square root of twice their number.
WIDTH = 1.5
#: From this calibrated score on a document is predicted good.
GOOD = 0.3
SEED = 11
#: Characters and words looked at a time.
BLOCK = 1 << 20

STATS = (
    "log_chars", "log_words", "log_lines", "word_len", "word_len_sd", "upper", "digit", "space", "other_ascii", "wide", "marks",
    "distinct_words", "top_word", "repeated_lines", "repeated_pairs", "capital_words", "symbol_words", "bare_words", "long_words", "entropy",
)
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "#*$%&|!~^<>{}[]=_\\/@+`"]] = True


def statistics(text: str | None) -> list[float]:
    """Shape of a whole text as numbers; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.zeros(256, dtype=np.int64)
    data = text.encode("utf-8", "replace")
    for at in range(0, len(data), BLOCK):
        raw += np.bincount(np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at), minlength=256)
    n = max(1, int(raw.sum()))
    words = text.split()
    lines = text.split("\n")
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = raw[raw > 0] / n
    letters = raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()
    ends = sum(map(str.isalnum, map(_last, words)))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(len(lines))), float(lengths.mean()), float(lengths.std()),
        float(raw[65:91].sum() / max(1, letters)), float(raw[48:58].sum() / n), float(raw[[9, 10, 13, 32]].sum() / n),
        float((n - letters - raw[48:58].sum() - raw[[9, 10, 13, 32]].sum()) / n), float(raw[128:].sum() / n), float(raw[_MARK].sum() / n),
        len(counts) / n_words, max(counts.values(), default=0) / n_words, 1 - len(set(lines)) / len(lines), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        sum(map(str.isupper, words)) / n_words, 1 - sum(map(_has_letter, words)) / n_words, ends / n_words, float((lengths > 20).mean()), float(-(share * np.log2(share)).sum()),
    ]


def _last(word: str) -> str:
    return word[-1]


def _has_letter(word: str) -> bool:
    return word[0].isalpha() or any(map(str.isalpha, word))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) for each row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measured, "doc_id long, stats array<float>")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent violators); equal x count as one."""
    knots, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, weights=y) / weight
    blocks: list[list[float]] = []
    for k in range(len(knots)):
        blocks.append([mean[k], weight[k], 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, c = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + c]
    return knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, whose dot products approximate a Gaussian kernel, and a constant."""
        z = np.sqrt(2 / len(self.phase)) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a trace of the raw score keeps the order within a step."""
        raw = self.raw(x)
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", held_out: int = 0, calibrate: int = 1, folds: int = 5, rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows outside fold ``held_out``; fold ``calibrate`` sets the isotonic step and the rest the ridge.

    About ``rows`` labelled rows are used, drawn by a hash of the id. Labels that are null or not 0 or 1, and ids without a document, teach
    nothing; without any usable row every score is 0.5.
    """
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull())
    usable = named.where(fold("doc_id", folds) != held_out)
    grain = 1 << 24
    least = min(grain, -(-rows * grain // max(1, usable.count())))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(grain)) < least)
    data = stored(stats.join(drawn, "doc_id").select("stats", "y", (fold("doc_id", folds) == calibrate).alias("step")).repartition(PARTS), "quality-fit")
    k = len(STATS)

    def summed(function, schema: pa.Schema, source: DataFrame) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = function(_matrix(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=float))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, dtype=np.float64).tobytes()], pa.binary())], names=["part"])

        found = [np.frombuffer(bytes(r.part)) for r in source.select("stats", "y").mapInArrow(run, schema).collect()]
        return sum(sorted(found, key=lambda a: a.tobytes())) if found else None

    rng = np.random.default_rng(SEED)
    weights, phase = rng.normal(size=(k, FEATURES)) / (WIDTH * np.sqrt(k)), rng.uniform(0, 2 * np.pi, FEATURES)
    moments = summed(lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), "part binary", data)
    empty = np.zeros(0)
    if moments is None:
        return Model(np.zeros(k), np.ones(k), weights, phase, np.zeros(FEATURES + 1), empty, empty)
    mean = moments[1 : k + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[k + 1 :] / moments[0] - mean**2, 0)) + 1e-6
    model = Model(mean, scale, weights, phase, np.zeros(FEATURES + 1), empty, empty)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(z)]])

    size = FEATURES + 1
    ridge_rows = data.where(~F.col("step"))
    total = summed(equations, "part binary", ridge_rows)
    if total is None:
        ridge_rows, total = data, summed(equations, "part binary", data)
    gram = total[: size * size].reshape(size, size)
    penalty = RIDGE * total[-1] * np.diag([1.0] * FEATURES + [0.0]) / FEATURES
    model.beta = np.linalg.solve(gram + penalty + 1e-9 * np.eye(size), total[size * size : -1])
    step = data.where("step").collect() or data.limit(FIT_ROWS).collect()
    model.knots, model.values = isotonic(model.raw(np.array([r.stats for r in step], dtype=float)), np.array([r.y for r in step], dtype=float))
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``document_statistics``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.score(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= GOOD).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(scored, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; a null text counts as empty and is scored like one.

    Texts are read once: their statistics are written to the shared folder, and fitting and scoring read only those.
    """
    stats = stored(document_statistics(docs), "quality-stats")
    found = score(stats, fit(stats, labels))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
