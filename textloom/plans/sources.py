"""Queries that write tables to the shared folder in the formats of the sources and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.plans.corpus import DOC_TOKENS, documents
from textloom.plans.evidence import _ATTACHED, asked
from textloom.operators import evidence as V
from textloom.plans.registry import register
from textloom.plans.rows import _TURNS, coded
from textloom.sources import readers as R
from textloom.storage import shared_dir, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def _sha() -> Column:
    return F.sha1(F.col("text").cast("binary")).alias("digest")


@register("parquet_text_scan", "SELECT sha1(text) AS digest, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def parquet_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    one, two = _path(spark, "shards") + "/a", _path(spark, "shards") + "/b"
    docs.where("doc_id % 2 = 0").select("lang", F.col("text").alias("content")).write.parquet(one)
    docs.where("doc_id % 2 = 1").select(F.when(F.col("doc_id") % 50 == 1, "").otherwise(F.col("text")).alias("content"), "source").unionByName(docs.where("doc_id % 50 = 1").select(F.col("text").alias("content"), "source")).write.parquet(two)
    both = R.parquet_texts(spark, one).unionByName(R.parquet_texts(spark, two))
    return both.groupBy(_sha()).agg(F.count("*").alias("n"))


@register("parquet_chat_scan", f"SELECT sha1(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM ({_TURNS}) GROUP BY conv_id")
def parquet_chat_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "chats")
    said = table(spark, sf, "conversations").where(F.col("role").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\S"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    said.groupBy("conv_id").agg(turns.alias("messages")).write.parquet(path)
    return R.parquet_chats(spark, path).select(_sha())


@register("json_lines_scan", "SELECT doc_id, lang, sha1(text) AS digest FROM documents")
def json_lines_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "lines")
    R.write_json_lines(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "gzip")
    return R.json_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", _sha())


@register("json_document_scan", "SELECT r_regionkey, r_name, 2 AS forms FROM region")
def json_document_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns = _path(spark, "rows"), _path(spark, "columns")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    region.agg(F.to_json(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value")).coalesce(1).write.text(rows)
    ordered = F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name")))
    region.agg(F.to_json(F.struct(F.transform(ordered, lambda r: r["r_regionkey"]).alias("r_regionkey"), F.transform(ordered, lambda r: r["r_name"]).alias("r_name"))).alias("value")).coalesce(1).write.text(columns)
    read = lambda p: R.json_documents(spark, p, "r_regionkey int, r_name string", ["r_name"])
    return read(rows).unionByName(read(columns)).groupBy("r_regionkey", "r_name").agg(F.count("*").cast("int").alias("forms"))


@register("tsv_scan", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def tsv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "tsv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.option("sep", "\t").option("header", "true").csv(path)
    return R.tsv(spark, path, ["p_partkey", "p_name"])


@register("question_split_scan", "SELECT item_id::VARCHAR AS id, substr(text, 1, 15) AS question, sha1(text) AS digest, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM benchmark")
def question_split_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "questions")
    answers = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("text", 1, 5)))
    table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("context"), F.substring("text", 1, 15).alias("question"), F.struct(answers.alias("text"), F.lit(0).alias("start")).alias("answers")).write.parquet(path)
    return R.question_split(spark, path).select("id", "question", F.sha1(F.col("context").cast("binary")).alias("digest"), F.size("answers").alias("n"))


@register("unused_files", "SELECT DISTINCT doc_id // 25 AS file FROM documents WHERE doc_id // 25 NOT IN (SELECT DISTINCT doc_id // 25 FROM labels WHERE toxic = 1)")
def unused_files(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators.mixing import exclude_seen

    file = F.floor(F.col("doc_id") / 25).alias("file")
    return exclude_seen(table(spark, sf, "documents").select(file).distinct(), table(spark, sf, "labels").where("toxic = 1").select(file), "file")


@register("masked_split_measure", f"SELECT sum(len(t))::BIGINT AS tokens, count(*) AS documents, sum(len(t) // 2)::BIGINT AS supervised FROM (SELECT {DOC_TOKENS} AS t FROM documents WHERE doc_id >= 40) WHERE len(t) > 0")
def masked_split_measure(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "masked")
    docs = documents(spark, sf).select("doc_id", "tokens", F.transform("tokens", lambda _, i: (i < F.floor(F.size("tokens") / 2)).cast("int")).alias("mask"))
    R.write_token_split(docs, path)
    R.checked_slice(spark, path)
    return R.measure(R.read_token_split(spark, path, 40))


@register("evidence_split", _ATTACHED + "SELECT qid AS doc_id, condition, answerable, len(chunks)::INT AS n FROM c")
def evidence_split(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "evidence")
    made = V.attached(asked(spark, sf), table(spark, sf, "benchmark"), 3, many=(4, 6))
    words = lambda c: F.split(c["text"], " ")
    ids = F.flatten(F.transform("chunks", words))
    numbers = F.flatten(F.transform("chunks", lambda c, i: F.array_repeat(i, F.size(words(c)))))
    tokens = F.split("target", " ")
    rows = made.select(F.col("qid").alias("doc_id"), tokens.alias("tokens"), F.transform(tokens, lambda _: F.lit(1)).alias("mask"), ids.alias("evidence"), numbers.alias("chunk_ids"), F.transform("chunks", lambda c: c["gold"]).alias("gold"), "condition", "answerable")
    R.write_evidence_split(rows, path)
    return R.checked_slice(spark, path).select("doc_id", "condition", "answerable", F.size("gold").alias("n"))


@register("coded_split", "SELECT count(*) AS documents, true AS same FROM customer")
def coded_split(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "coded")
    docs = coded(spark, sf).select(F.col("key").alias("doc_id"), F.transform("tokens", lambda t: t["token"]).alias("tokens"), F.transform("codes", lambda c: F.lit(1)).alias("mask"), "codes")
    R.write_coded_split(docs, path)
    back = spark.read.parquet(path)
    return back.join(docs.select("doc_id", F.col("codes").alias("c")), "doc_id").agg(F.count("*").alias("documents"), F.bool_and(F.col("codes") == F.col("c")).alias("same"))


@register("file_listing", "SELECT count(*) > 0 AS some, true AS parquet FROM region")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "listed")
    table(spark, sf, "region").write.parquet(path)
    files = R.listing(spark, path, prefix="part-", suffix=".parquet", without="_no_think")
    return files.agg((F.count("*") > 0).alias("some"), F.bool_and(F.endswith("file", F.lit(".parquet"))).alias("parquet"))
