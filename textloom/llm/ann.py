"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph with joins, greedy search walks it.

Equal vectors are one node, so copies cost nothing. A forest of random-projection trees, shaped on a bounded sample, deals the nodes into
small leaves and gives each its first neighbours; rounds of NN-descent then compare the neighbours of every node with each other. All
tables are keyed by node and shuffled; the driver holds the sample and a few entry points only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm.native import hint
from textloom.storage import Stored, stored

#: Neighbours of a node in the graph, reverse neighbours that a round adds, and candidates that a node takes from one comparison.
DEGREE, REVERSE, TAKEN = 36, 36, 20
#: Vectors that shape the trees, nodes aimed at in a leaf, trees, rounds, and the share of changed edges that ends the rounds.
SAMPLE, LEAF, TREES, ROUNDS, STILL = 20_000, 300, 3, 8, 0.01
#: Nodes whose neighbours one task compares at a time.
TOGETHER = 400
#: Beam of a search, nodes it expands in a round, rounds, and entry points.
BEAM, EXPANDED, STEPS, ENTRIES = 192, 48, 7, 64
SEED = 5


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nodes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(cid, vec, members) of the distinct vectors and (vec_id, cid) of all rows that take part.

    Null and empty vectors, zero vectors, and those with a null or non-finite component take no part. Shorter vectors are compared as if
    zeros followed up to the length of the longest. members are the k + 1 smallest ids of a vector, all that k nearest neighbours can need; cid is the smallest.
    """
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec")).where("vec_id is not null")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    whole = whole.where(good)
    least, most = whole.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if least != most:
        whole = whole.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vec"))))
    whole = whole.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    first = whole.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = first.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.min_by("vec", "vec_id").alias("vec"), F.array_sort(F.collect_set("vec_id")).alias("members"))
    classes = stored(classes, "ann-nodes")
    ids = whole.select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("vec_id", "cid")
    return classes.select("cid", "vec", "members"), ids


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["cid", "unit"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)


class ProjectionTree:
    """Hyperplanes that halve a sample again and again; a negative child -1 - k is leaf k."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.planes, self.cuts, self.child, self.leaves = [], [], [], 0
        top = [[0]]
        stack = [(sample, top[0], 0)]
        while stack:
            own, slot, side = stack.pop()
            if len(own) > leaf:
                a, b = own[rng.integers(len(own))], own[rng.integers(len(own))]
                plane = a - b if np.any(a != b) else rng.normal(size=own.shape[1]).astype(np.float32)
                at = own @ plane
                cut = float(np.median(at))
                if 0 < (low := at <= cut).sum() < len(own):
                    slot[side] = len(self.planes)
                    self.planes.append(plane)
                    self.cuts.append(cut)
                    self.child.append([0, 0])
                    stack += [(own[low], self.child[-1], 0), (own[~low], self.child[-1], 1)]
                    continue
            slot[side] = -1 - self.leaves
            self.leaves += 1
        self.root = top[0][0]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        planes, cuts, child = np.array(self.planes, dtype=np.float32), np.array(self.cuts), np.array(self.child)
        while (open_ := np.flatnonzero(at >= 0)).size:
            n = at[open_]
            at[open_] = child[n, (np.einsum("ij,ij->i", x[open_], planes[n]) > cuts[n]).astype(int)]
        return -1 - at


def _best(ids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s): for each row its k most similar other rows with a similarity over its ``least``."""
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -2
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], s[:0, 0]
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(s, top, axis=1)
    rows, cols = np.nonzero(score > least[:, None])
    return ids[rows], ids[top[rows, cols]], score[rows, cols]


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    a, b, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
    return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64()), "s": pa.array(s.astype(np.float32), pa.float32())})


_EDGE = "u long, v long, s float"


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).where(F.col("r") <= k).drop("r")


def _first_graph(units: DataFrame, total: int) -> DataFrame:
    every = max(1, total // SAMPLE)
    drawn = units.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0).orderBy("cid").collect()
    sample = np.frombuffer(b"".join(bytes(r.unit) for r in drawn), dtype=np.float16).reshape(len(drawn), -1 if drawn else 0).astype(np.float32)
    rng = np.random.default_rng(SEED)
    trees = [ProjectionTree(sample, max(8, LEAF * len(sample) // max(1, total)), rng) for _ in range(TREES)]
    shared = units.sparkSession.sparkContext.broadcast(trees)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                for k, tree in enumerate(shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array((tree.leaf_of(x) * TREES + k).astype(np.int64)), *batch.columns], names=["leaf", "cid", "unit"])

    placed = units.mapInArrow(dealt, "leaf long, cid long, unit binary")
    # a leaf that came out large is cut by hash, so that no task compares more than a few thousand nodes
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / (8 * LEAF)).cast("int")).drop("n")
    cut = placed.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("cid", "leaf"), F.col("cuts")))

    def compared(rows: pa.Table) -> pa.Table:
        ids = rows.column("cid").to_numpy()
        return _edges([_best(ids, _matrix(rows.column("unit")), np.full(len(ids), -1.5, np.float32), DEGREE)])

    return _nearest(cut.groupBy("leaf", "part").applyInArrow(compared, _EDGE), DEGREE)


def neighbour_graph(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, edges): half-precision unit vectors by cid, and the graph (u, v, s) with DEGREE neighbours of each node at most."""
    units = stored(classes.select("cid", "vec").mapInArrow(_units, "cid long, unit binary"), "ann-units")
    total = units.count()
    graph = Stored(_first_graph(units, total), "ann-graph")
    groups = max(1, math.ceil(total / TOGETHER))

    def compared(rows: pa.Table) -> pa.Table:
        centre = rows.column("c").to_numpy()
        order = np.argsort(centre, kind="stable")
        ids, x, least = rows.column("m").to_numpy()[order], _matrix(rows.column("unit"))[order], rows.column("least").to_numpy()[order]
        ends = np.flatnonzero(np.diff(centre[order])) + 1
        return _edges([_best(ids[a:b], x[a:b], least[a:b], TAKEN) for a, b in zip([0, *ends], [*ends, len(ids)], strict=True)])

    for _ in range(ROUNDS if total > LEAF else 0):
        edges = graph.df
        back = edges.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).where(F.col("r") <= REVERSE)
        around = edges.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(back.select(F.col("v").alias("c"), F.col("u").alias("m"))).distinct()
        least = edges.groupBy("u").agg(F.min("s").alias("least"), F.count("*").alias("n")).select(F.col("u").alias("m"), F.when(F.col("n") < DEGREE, -1.5).otherwise(F.col("least")).cast("float").alias("least"))
        carried = units.withColumnRenamed("cid", "m").join(least, "m")
        met = around.join(carried, "m").withColumn("g", F.pmod(F.xxhash64("c"), F.lit(groups)))
        better = met.groupBy("g").applyInArrow(compared, _EDGE)
        following = Stored(_nearest(edges.unionByName(better), DEGREE), "ann-graph")
        changed = following.df.join(edges, ["u", "v"], "left_anti").count()
        graph.drop()
        graph = following
        if changed <= STILL * total * DEGREE:
            break
    return units, graph.df


def search(queries: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, v, s): the BEAM nodes that a greedy walk from the entry points finds for each query (q, unit).

    A query that is itself a node starts there as well. Each step expands the nearest unexpanded nodes of the beam.
    """
    spark = queries.sparkSession
    total = max(1, units.count())
    entries = units.where(F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(max(1, total // ENTRIES))) == 0).select(F.col("cid").alias("v"), F.col("unit").alias("other")).collect()
    entry_ids, entry_x = np.array([r.v for r in entries], dtype=np.int64), [bytes(r.other) for r in entries]
    shared = spark.sparkContext.broadcast((entry_ids, entry_x))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                s = _matrix(batch.column(1)) @ _matrix(pa.array(raw, pa.binary())).T
                near = np.argsort(-s, axis=1, kind="stable")[:, :4]
                q = np.repeat(batch.column(0).to_numpy(), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(s, near, axis=1).ravel().astype(np.float32))], names=["q", "v", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))], names=["q", "v", "s"])

    start = queries.mapInArrow(entered, "q long, v long, s float").unionByName(queries.join(units, queries.q == units.cid, "left_semi").select("q", F.col("q").alias("v"), F.lit(1.0).cast("float").alias("s")))
    beam = Stored(start.dropDuplicates(["q", "v"]).withColumn("done", F.lit(False)), "ann-beam")
    by_nearness = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    for _ in range(STEPS):
        state = beam.df
        ranked = state.withColumn("open_rank", F.when(~F.col("done"), F.row_number().over(Window.partitionBy("q", "done").orderBy(F.desc("s"), "v"))))
        opened = F.col("open_rank") <= EXPANDED
        steps = ranked.where(opened).join(edges.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("q", F.col("w").alias("v")).distinct().join(state, ["q", "v"], "left_anti")
        scored = steps.join(queries, "q").join(units.select(F.col("cid").alias("v"), F.col("unit").alias("other")), "v").select("q", "v", "unit", "other").mapInArrow(similar, "q long, v long, s float")
        merged = ranked.select("q", "v", "s", (F.col("done") | F.coalesce(opened, F.lit(False))).alias("done")).unionByName(scored.withColumn("done", F.lit(False)))
        following = Stored(merged.withColumn("r", F.row_number().over(by_nearness)).where(F.col("r") <= BEAM).drop("r"), "ann-beam")
        beam.drop()
        beam = following
        if not beam.df.where(~F.col("done")).take(1):
            break
    return beam.df.select("q", "v", "s")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (over vec_id) the k nearest rows found, by cosine in double precision.

    Ties go to the smaller id; a query's own id is no candidate. Rows that take no part (see ``nodes``) are neither queries nor answers.
    Rows that repeat an id with one vector count once. With fewer than k others all of them come. Other columns are never read. A query
    vector that many rows share is searched once, and a shared candidate vector stands for its k + 1 smallest ids.
    """
    classes, ids = nodes(vectors, id_col, vec_col, k)
    units, edges = neighbour_graph(classes)
    asked = stored(ids.where(is_query).distinct(), "ann-queries")
    queries = stored(units.join(asked.select("cid").distinct(), "cid").select(F.col("cid").alias("q"), "unit"), "ann-query-units")
    found = search(queries, units, edges).select("q", F.col("v").alias("cid"))
    found = stored(found.unionByName(queries.select("q", F.col("q").alias("cid"))).distinct(), "ann-found")
    own = classes.select(F.col("cid").alias("q"), F.col("vec").alias("qvec"))
    pairs = found.join(classes, "cid").join(own, "q")
    cosine = _dot(F.col("qvec"), F.col("vec")) / (F.sqrt(_dot(F.col("qvec"), F.col("qvec"))) * F.sqrt(_dot(F.col("vec"), F.col("vec"))))
    scored = pairs.select("q", F.explode("members").alias("vec_id"), cosine.alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")).join(hint(stored(best, "ann-best")), "q").where(F.col("query_id") != F.col("vec_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
