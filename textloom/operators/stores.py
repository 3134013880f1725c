"""Chunk stores: building one from documents and questions, editing it, and checking what is written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.text import contains_answer, order_key
from textloom.operators.mixing import hash_bucket, running_total
from textloom.operators.vectors import KEY_BLOCK, QUERY_BLOCK, blocks
from textloom.storage import Stored, stored


def store_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, text, source, doc_id) of the distinct texts, and (source, doc_id, chunk_id) of every document's chunks.

    ``chunks`` has rank (of the source), source, doc_id, chunk and text. The first place of a text, by rank, document and chunk, owns it;
    ids are dense from 0 in the order of those places. The numbering takes two levels, over ranges of 4096 documents.
    """
    place = F.struct("rank", "doc_id", "chunk", "source")
    owned = stored(chunks.groupBy("text").agg(F.min(place).alias("own")).select("text", "own.*"), "store-texts")
    bucket = F.col("rank") * (1 << 32) + F.floor(F.col("doc_id") / 4096)
    numbered = running_total(owned, bucket, [F.col("rank"), F.col("doc_id"), F.col("chunk")], F.lit(1), "chunk_id").withColumn("chunk_id", F.col("chunk_id") - 1)
    numbered = stored(numbered.select("chunk_id", "text", "source", "doc_id"), "store-chunks")
    held = chunks.select("source", "doc_id", "text").join(numbered.select("text", "chunk_id"), "text").select("source", "doc_id", "chunk_id").distinct()
    return numbered, held


def gold_labels(questions: DataFrame, chunks: DataFrame, held: DataFrame) -> DataFrame:
    """(qid, source, gold_groups, gold_chunk_ids): the chunks of each question's gold documents; questions without any are left out.

    ``questions`` has qid, source, mode, answers and gold_docs, an array of groups of doc ids. Under the mode ``answer`` only chunks that
    hold an answer count. Groups without a chunk are left out.
    """
    wanted = questions.select("qid", "source", "mode", "answers", F.posexplode("gold_docs").alias("g", "docs")).select("qid", "source", "mode", "answers", "g", F.explode("docs").alias("doc_id"))
    met = wanted.join(held, ["source", "doc_id"]).join(chunks.select("chunk_id", "text"), "chunk_id")
    gold = met.where((F.col("mode") != "answer") | F.exists("answers", lambda a: contains_answer(F.col("text"), a)))
    groups = gold.groupBy("qid", "source", "g").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("g", "ids")))
    found = groups.groupBy("qid", "source").agg(F.transform(ordered, lambda x: x["ids"]).alias("gold_groups"))
    return found.select("qid", "source", "gold_groups", F.array_sort(F.array_distinct(F.flatten("gold_groups"))).alias("gold_chunk_ids"))


def near_any(golds: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(qid, id): keys with a cosine of ``least`` or more to any gold of a question, its gold left out.

    ``golds`` has qid and id, ``keys`` id and vec. Each distinct gold meets all keys in blocks, a matrix product each, that pass on only
    pairs over the threshold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = np.asarray(r.q_ids, dtype=np.int64), np.asarray(r.k_ids, dtype=np.int64)
                unit = lambda v, n: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))(np.asarray(v, dtype=np.float64).reshape(n, -1))
                i, j = np.nonzero(np.round(unit(r.q_values, len(a)) @ unit(r.k_values, len(b)).T, 9) >= least)
                yield pd.DataFrame({"gold": a[i], "id": b[j]})

    distinct = stored(golds.select("id").distinct().join(keys, "id").select("id", "vec"), "gold-keys")
    pairs = blocks(distinct, QUERY_BLOCK, "q").crossJoin(blocks(keys, KEY_BLOCK, "k")).mapInPandas(run, "gold long, id long")  # blocks of stated golds
    near = golds.select("qid", F.col("id").alias("gold")).join(pairs, "gold").select("qid", "id").distinct()
    return near.join(golds.select("qid", "id"), ["qid", "id"], "left_anti")


def exclusive_claims(wanted: DataFrame, seed: int = 42) -> DataFrame:
    """(qid): the questions that get all they want when they ask in a seeded order and what is claimed is gone.

    ``wanted`` has qid and id. A question is granted if it is the first among the undecided that want any of its ids, and refused if
    another was granted one of them; rounds go on until all are decided. That gives the sequential result, each round two aggregations.
    """
    open_ = Stored(wanted.select("qid", "id").distinct().withColumn("turn", F.struct(order_key(seed, F.col("qid")).alias("h"), F.col("qid").alias("q"))), "claims")
    granted = []
    while open_.df.take(1):
        first = open_.df.groupBy("id").agg(F.min("turn").alias("first"))
        seen = open_.df.join(first, "id")
        won = Stored(seen.groupBy("qid").agg(F.bool_and(F.col("turn") == F.col("first")).alias("ok")).where("ok").select("qid"), "claims-won")
        granted.append(won.df)
        gone = open_.df.join(won.df, "qid").select("id").distinct()
        out = open_.df.join(gone, "id").select("qid").distinct()
        left = Stored(open_.df.join(out, "qid", "left_anti"), "claims")
        open_.drop()
        open_ = left
    if not granted:
        return wanted.select("qid").where("false")
    found = granted[0]
    for g in granted[1:]:
        found = found.unionByName(g)
    return found


def dense(kept: DataFrame, key: str = "chunk_id", name: str = "new_id") -> DataFrame:
    """(key, name): dense numbers from 0 in the order of the key, two-level."""
    return running_total(kept.select(key), F.floor(F.col(key) / 4096), [F.col(key)], F.lit(1), name).withColumn(name, F.col(name) - 1)


def store_problems(chunks: DataFrame, width: int, key: str = "chunk_id", vec: str = "vec") -> DataFrame:
    """(problem, n): what is wrong with a store: ids that repeat or leave gaps, vectors of another width, texts that are empty."""
    seen = chunks.groupBy(key).agg(F.count("*").alias("n"))
    total = chunks.agg(F.count("*").alias("rows"), F.count_if(F.size(vec) != width).alias("wide"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("blank"))
    ids = seen.agg(F.count("*").alias("kinds"), F.coalesce(F.max(key), F.lit(-1)).alias("last"), F.count_if(F.col("n") > 1).alias("twice"))
    found = total.crossJoin(F.broadcast(ids))  # one row each
    rules = [("ids repeat", F.col("twice")), ("ids leave gaps", F.col("last") + 1 - F.col("kinds")), ("vectors of another width", F.col("wide")), ("empty texts", F.col("blank"))]
    return found.select(F.explode(F.array(*(F.struct(F.lit(p).alias("problem"), n.cast("long").alias("n")) for p, n in rules))).alias("x")).select("x.*").where("n > 0")


def write_store(chunks: DataFrame, path: str, width: int) -> None:
    """Writes a store after its checks; problems are an error that names them."""
    wrong = store_problems(chunks, width).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in wrong))
    chunks.write.parquet(path)


def read_store(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A written store, checked again; problems are an error that names them."""
    chunks = spark.read.parquet(path)
    wrong = store_problems(chunks, width).collect()
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(f"{r.problem}: {r.n}" for r in wrong))
    return chunks


def looked_up(asked: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``asked`` with the columns of ``known`` by its unique key; a key that isn't known is an error that names the first."""
    lost = asked.join(known, key, "left_anti").select(key).limit(1).collect()
    if lost:
        raise KeyError(f"{key} {lost[0][0]!r} isn't known")
    return asked.join(known.select(key, *columns), key)


def priority(seed: int, key: Column) -> Column:
    """The bucket of a seeded turn, for numbering questions in it."""
    return hash_bucket(order_key(seed, key))
