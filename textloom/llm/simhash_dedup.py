"""SimHash near duplicates, searched with vantage-point trees over Hamming distance.

A 64-bit fingerprint is cut into two 32-bit halves. Two fingerprints that differ in at most 3 bits agree in one half up to 1 bit, so a
tree per half with search radius 1 finds every pair. A tree node holds a vantage point and a radius m: the inner branch takes values at
distance <= m + 1, the outer branch those at distance > m. By the triangle inequality two values within distance 1 always share a branch,
and only the boundary shell m + 1 goes to both. Leaves are the shards; a shard is searched exactly on whole fingerprints and gives a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm.batches import bounded
from textloom.llm.components import connected_components
from textloom.llm.native import free_name, hint
from textloom.storage import stored

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HALF_RADIUS = MAX_BITS // 2
#: Most fingerprints that the driver gathers to shape the trees; exactness doesn't depend on them.
SAMPLE = 1 << 18
#: Fingerprints aimed at in a leaf, and the most that one task searches at once (2 MB); a larger shard is searched through trees of its own.
LEAF, SHARD = 1500, 1 << 18
#: Bytes of text whose words are held at a time.
BLOCK = 1 << 22

_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def _word_runs(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text in runs, the last two words of a run opening the next."""
    if len(raw) <= BLOCK:
        yield raw.lower().split()
        return
    carry: list[bytes] = []
    rest = b""
    for at in range(0, len(raw), BLOCK):
        piece = rest + raw[at : at + BLOCK].lower()
        words = piece.split()
        rest = b""
        if at + BLOCK < len(raw) and words and not piece[-1:].isspace():
            rest = words.pop()
        run = carry + words
        if len(run) >= SHINGLE or at + BLOCK >= len(raw):
            yield run
            carry = run[-(SHINGLE - 1) :]
        else:
            carry = run


def fingerprint(raw: bytes | None) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit value; a text without words (or null) has 0."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for words in _word_runs(raw or b""):
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        elif words and not n:
            shingles = iter([b" ".join(words)])
        else:
            continue
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
        n += len(hashes)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    value = sum(1 << b for b in range(64) if 2 * counts[b] > n)
    return value - (1 << 64) if value >> 63 else value


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row."""
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


class HammingTree:
    """A vantage-point tree over 32-bit values as flat arrays; a negative child -1 - k is leaf k."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int = HALF_RADIUS):
        self.radius, self.leaves = radius, 0
        self.point: list[int] = []
        self.within: list[int] = []
        self.child: list[list[int]] = []
        self.root = self._grow(np.unique(sample.astype(np.uint32)), max(2, leaf))
        self.point, self.within = np.array(self.point, dtype=np.uint32), np.array(self.within, dtype=np.int64)
        self.child = np.array(self.child, dtype=np.int64).reshape(-1, 2)

    def _split(self, values: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        best, most = None, 0.85 * float(len(values)) ** 2
        for point in values[:: max(1, len(values) // 6)][:6]:
            apart = np.bitwise_count(values ^ point)
            below = np.cumsum(np.bincount(apart, minlength=34 + self.radius)).astype(float)
            work = below[self.radius :][:33] ** 2 + (len(values) - below[:33]) ** 2
            at = int(np.argmin(work))
            if work[at] < most:
                best, most = (int(point), at, apart), work[at]
        return best

    def _grow(self, values: np.ndarray, leaf: int) -> int:
        top: list[list[int]] = [[0]]
        stack = [(values, top[0], 0)]
        while stack:
            own, slot, side = stack.pop()
            found = self._split(own) if len(own) > leaf else None
            if found is None:
                slot[side] = -1 - self.leaves
                self.leaves += 1
                continue
            point, at, apart = found
            slot[side] = len(self.point)
            self.point.append(point)
            self.within.append(at)
            self.child.append([0, 0])
            stack += [(own[apart <= at + self.radius], self.child[-1], 0), (own[apart > at], self.child[-1], 1)]
        return top[0][0]

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each shard that a value belongs to or whose boundary it touches."""
        rows, nodes = np.arange(len(values)), np.full(len(values), self.root, dtype=np.int64)
        out_rows, out_leaves = [], []
        while len(rows):
            done = nodes < 0
            out_rows.append(rows[done])
            out_leaves.append(-1 - nodes[done])
            rows, nodes = rows[~done], nodes[~done]
            if not len(rows):
                break
            apart = np.bitwise_count(values[rows] ^ self.point[nodes]).astype(np.int64)
            near, far = apart <= self.within[nodes] + self.radius, apart > self.within[nodes]
            rows, nodes = np.concatenate([rows[near], rows[far]]), np.concatenate([self.child[nodes[near], 0], self.child[nodes[far], 1]])
        return (np.concatenate(out_rows), np.concatenate(out_leaves)) if out_rows else (rows, nodes)


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = fps.astype(np.int64).view(np.uint64)
    return (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32), (whole >> np.uint64(32)).astype(np.uint32)


def spanning_links(fps: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (value, smallest value of its group) of the groups that values within ``bits`` of each other form."""
    values = np.unique(fps).view(np.uint64)
    n = len(values)
    step = max(1, (1 << 18) // max(n, 1))
    close = np.zeros(n, dtype=bool)
    for at in range(0, n, step):
        close[at : at + step] = (np.bitwise_count(values[at : at + step, None] ^ values[None, :]) <= bits).sum(axis=1) > 1
    left, links = values[close], []
    while len(left):
        group, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            step, hit = max(1, (1 << 18) // len(left)), np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), step):
                open_ = ~hit
                hit[open_] = (np.bitwise_count(front[at : at + step, None] ^ left[None, open_]) <= bits).any(axis=0)
            front, left = left[hit], left[~hit]
            group.append(front)
        whole = np.concatenate(group).view(np.int64)
        low = int(whole.min())
        links += [(int(x), low) for x in whole if x != low]
    return links


def shard_links(fps: np.ndarray, half: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links of one shard, as ``spanning_links`` of all its values; ``half`` is the half of the fingerprint that dealt it.

    A large shard is cut by a tree over that half, and what the tree can't cut, as its values agree there, by one over the other half, in
    which two fingerprints differ by all their bits at most.
    """
    links, todo = [], [(np.unique(fps), half, HALF_RADIUS)]
    while todo:
        values, side, radius = todo.pop()
        if len(values) <= 2 * leaf or side is None:
            links += spanning_links(values)
            continue
        own = _halves(values)[side]
        tree = HammingTree(own, leaf, radius)
        rows, leaves = tree.route(own)
        order = np.argsort(leaves, kind="stable")
        for part in np.split(rows[order], np.flatnonzero(np.diff(leaves[order])) + 1):
            todo.append((values[part], 1 - half if side == half else None, MAX_BITS))
    return links


def near_links(distinct: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, shard: int = SHARD) -> DataFrame:
    """(u, v): a spanning forest of the links between the fingerprints in column fp of ``distinct``, whose rows must be distinct.

    The driver gathers about ``sample`` fingerprints at most (by hash) and shapes both trees with them. A leaf that holds more than
    ``shard`` fingerprints is cut by hash into blocks, and each pair of blocks is searched by a task of its own, so no task grows with a
    dense ball of near copies and no link is lost.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    every = max(1, math.ceil(total / sample))
    seen = np.array([r[0] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").collect()], dtype=np.int64)
    trees = [HammingTree(x, max(8, leaf * len(seen) // max(1, total))) for x in _halves(seen)]
    offsets = [0, trees[0].leaves]
    shared = spark.sparkContext.broadcast((trees, offsets))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for tree, base, half in zip(own, start, _halves(fps), strict=True):
                rows, leaves = tree.route(half)
                yield pa.RecordBatch.from_arrays([pa.array(leaves + base, pa.int64()), pa.array(fps[rows], pa.int64())], names=["leaf", "fp"])

    placed = distinct.select("fp").mapInArrow(routed, "leaf long, fp long")
    blocks = {r.leaf: math.ceil(2 * r.n / shard) for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > shard).collect()}
    pairs = placed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if blocks:
        cut = spark.createDataFrame([(k, n) for k, n in blocks.items()], "leaf long, blocks int")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = placed.join(F.broadcast(cut), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn("other", other)
        pairs = dealt.select("leaf", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def searched(shard_table: pa.Table) -> pa.Table:
        links = shard_links(shard_table.column("fp").to_numpy(), int(shard_table.column("leaf")[0].as_py() >= offsets[1]))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return pairs.groupBy("leaf", "i", "j").applyInArrow(searched, "u long, v long")


def _classes(distinct: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root is the smallest fingerprint that its links reach."""
    roots = connected_components(near_links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(distinct.fp, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of at most 3 differing bits reach.

    A null text counts as empty; texts without words have fingerprint zero and link like any other; repeated rows are kept and link with
    each other. Rows whose id is null come back with the component of their fingerprint, null if no id is known there. Other columns of
    ``docs`` are never read; an empty table gives an empty one. Copies meet by aggregation before any search, so a fingerprint that a third
    of the rows share costs one row.
    """
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    kinds = distinct.count()
    grouped = stored(_classes(distinct).join(distinct, "fp"), "fingerprint-roots", kinds)
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stored(grouped.join(lows, "root").select("fp", "component_id"), "fingerprint-classes", kinds)
    return marked.join(hint(classes), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of near duplicates: that of the smallest id, then text hash.

    Rows are told apart by themselves and not by their ids, so ids may be null (these come last) or repeat with one text or several. The
    rows get numbers in a written table, so which one stays can't change when a lost executor's work is done again.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).cast(pa.binary())
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, fp])

    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    rows = stored(bounded(docs).mapInArrow(marked, schema).withColumn(row, F.monotonically_increasing_id()), "marked-documents")
    place = F.struct(F.col(id_col).isNull().alias("n"), F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(row).alias("r"))
    best = stored(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("place")), "first-of-fingerprint")
    first = best.join(_classes(best.select("fp")), "fp").groupBy("root").agg(F.min("place").alias("place"))
    kept = stored(first.select(F.col("place.r").alias(row)), "representatives", best.count())
    return rows.join(hint(kept), row, "left_semi").drop(fp, row)
