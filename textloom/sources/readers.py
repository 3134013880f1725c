"""Text, record and token sources in the shapes that corpora come in."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Names a text column may have, the first found wins.
TEXT_COLUMNS = ("text", "content", "document", "raw_content")


def resolve_text_column(columns: list[str], candidates: tuple[str, ...] = TEXT_COLUMNS) -> str:
    """The first candidate that exists; an error that lists the columns if none does."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {list(candidates)} among the columns {columns}")


def parquet_texts(spark: SparkSession, path: str, candidates: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """(text, file): non-empty texts and the shard they come from; only the text column is read."""
    df = spark.read.parquet(path)
    name = resolve_text_column(df.columns, candidates)
    return df.select(F.col(name).cast("string").alias("text"), F.col("_metadata.file_name").alias("file")).where("text IS NOT NULL AND text <> ''")


def parquet_chats(spark: SparkSession, path: str, messages: str = "messages") -> DataFrame:
    """(text): rendered conversations of a messages column, empty contents skipped, empty results dropped."""
    said = F.filter(F.col(messages), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    text = F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return spark.read.parquet(path).select(text.alias("text")).where("text <> ''")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Plain or gzip JSON lines; blank lines are skipped. Give a schema at scale: inference reads everything."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


#: Schemes that Arrow opens itself, so that a file is streamed and never held; others are read whole by Spark, up to 2 GB a file.
STREAMED = ("file", "hdfs", "s3", "gs")


def json_lines_zstd(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Zstandard JSON lines as string columns, each file decompressed as a stream by one task whatever codecs Hadoop has."""

    def parsed(raw: io.RawIOBase) -> Iterator[pd.DataFrame]:
        rows = []
        for line in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True), encoding="utf-8"):
            if line.strip():
                found = json.loads(line)
                rows.append([None if found.get(f) is None else str(found[f]) for f in fields])
            if len(rows) == 4096:
                yield pd.DataFrame(rows, columns=fields)
                rows = []
        yield pd.DataFrame(rows, columns=fields)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                system, name = fs.FileSystem.from_uri(uri if ":///" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))
                with system.open_input_stream(name, compression=None) as raw:
                    yield from parsed(raw)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                yield from parsed(io.BytesIO(raw))

    files = spark.read.format("binaryFile").load(path)
    schema = ", ".join(f"`{f}` string" for f in fields)
    first = files.select("path").limit(1).collect()
    if first and first[0].path.split(":", 1)[0] in STREAMED:
        return files.select("path").repartition(F.col("path")).mapInPandas(opened, schema)
    return files.select("content").mapInPandas(held, schema)


def write_json_lines(df: DataFrame, path: str, codec: str = "none") -> None:
    """JSON lines, committed as a whole; null fields are left out."""
    df.write.mode("errorifexists").option("compression", codec).json(path)


def question_split(spark: SparkSession, path: str) -> DataFrame:
    """(id, context, question, answers) of a question split: Parquet rows with answers as a struct of text, or as an array of texts."""
    rows = spark.read.parquet(path)
    kind = rows.schema["answers"].dataType
    answers = F.col("answers.text") if hasattr(kind, "fieldNames") else F.col("answers")
    return rows.select(F.col("id").cast("string").alias("id"), "context", "question", F.coalesce(answers, F.array().cast("array<string>")).alias("answers"))


def checked_slice(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a slice, plain or with evidence, after its lengths are checked against each other; a mismatch names its first document.

    mask is as long as tokens; with evidence, chunk numbers are as many as evidence tokens and flags as many as chunks.
    """
    docs = spark.read.parquet(path)
    rules = [("mask", F.size("mask") == F.size("tokens"))] if "mask" in docs.columns else []
    if "evidence" in docs.columns:
        rules += [("chunk numbers", F.size("chunk_ids") == F.size("evidence")), ("flags", F.size("gold") == F.coalesce(F.array_max("chunk_ids") + 1, F.lit(0)))]
    for name, holds in rules:
        wrong = docs.where(~F.coalesce(holds, F.lit(False))).select("doc_id").limit(1).collect()
        if wrong:
            raise ValueError(f"{path}: {name} of document {wrong[0].doc_id} have another length")
    return docs


def write_evidence_split(docs: DataFrame, path: str) -> None:
    """An evidence split: doc_id, tokens, mask, evidence, chunk_ids, gold, condition and answerable, lengths checked row by row as it is written."""
    fits = (F.size("mask") == F.size("tokens")) & (F.size("chunk_ids") == F.size("evidence")) & (F.size("gold") == F.coalesce(F.array_max("chunk_ids") + 1, F.lit(0)))
    checked = docs.withColumn("tokens", F.when(fits, F.col("tokens")).otherwise(F.raise_error(F.lit("tokens, mask, evidence, chunks and flags differ in length"))))
    checked.write.mode("errorifexists").parquet(path)


def write_coded_split(docs: DataFrame, path: str) -> None:
    """A split whose tokens carry span codes: doc_id, tokens, mask and codes of one length, checked as it is written."""
    fits = (F.size("mask") == F.size("tokens")) & (F.size("codes") == F.size("tokens"))
    docs.withColumn("tokens", F.when(fits, F.col("tokens")).otherwise(F.raise_error(F.lit("tokens, mask and codes differ in length")))).write.mode("errorifexists").parquet(path)


def packed(split: DataFrame, claimed: dict[str, int]) -> list[str]:
    """Problems of an archived split: counts that differ from those claimed for it; none if it is whole."""
    found = measure(split).first().asDict()
    return [f"{k}: {found[k]} measured, {n} claimed" for k, n in claimed.items() if found.get(k) != n]


def json_documents(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a JSON file that is a list of rows, or a dict of equally long columns."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).first()
    if first is None or first[0] == "[":
        rows = spark.read.schema(schema).json(path, multiLine=True)
    else:
        fields = spark.createDataFrame([], schema).schema.fields
        columns = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in fields)
        names = [f.name for f in fields]
        rows = spark.read.schema(columns).json(path, multiLine=True).select(F.inline(F.arrays_zip(*names)))
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return rows


def tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A tab-separated table whose header must hold ``required``."""
    rows = spark.read.csv(path, sep="\t", header=True)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return rows


def listing(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", without: str = "") -> DataFrame:
    """(file, bytes) of the files under a path, filtered and sorted."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("file"), F.col("length").alias("bytes"))
    kept = files.where(F.startswith("file", F.lit(prefix)) & F.endswith("file", F.lit(suffix)))
    return (kept.where(~F.contains("file", F.lit(without))) if without else kept).orderBy("file")


def write_token_split(docs: DataFrame, path: str) -> None:
    """A token split: doc_id, tokens and, if present, mask of the same length; a length mismatch fails the write."""
    if "mask" in docs.columns:
        docs = docs.withColumn("mask", F.when(F.size("mask") == F.size("tokens"), F.col("mask")).otherwise(F.raise_error(F.lit("mask and tokens differ in length"))))
    docs.write.mode("errorifexists").parquet(path)


def read_token_split(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Documents of a split from a cursor on, those without tokens skipped."""
    return spark.read.parquet(path).where((F.col("doc_id") >= start) & (F.size("tokens") > 0))


def measure(split: DataFrame) -> DataFrame:
    """tokens, documents and supervised tokens of a split."""
    supervised = F.sum(F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m)) if "mask" in split.columns else F.lit(0).cast("long")
    return split.agg(F.sum(F.size("tokens")).cast("long").alias("tokens"), F.count("*").alias("documents"), supervised.alias("supervised"))
