"""Training rows of a fixed length: placing documents is sequential over lengths alone, everything else is joins and expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.tokens import packed_blocks, packed_evidence

BOS, EOS, PAD = "<s>", "</s>", "<pad>"


def with_start(ids: Column, bos: str = BOS) -> Column:
    """The ids with the start mark in front unless they begin with it; no ids stay none."""
    return F.when((F.size(ids) > 0) & (F.get(ids, F.lit(0)) != bos), F.concat(F.array(F.lit(bos)), ids)).otherwise(ids)


def over_limit(ids: Column, row_len: int, seps: int, bos: str = BOS) -> Column:
    """Whether a document, with its start mark and separators, is longer than a row."""
    return F.size(ids) + F.when((F.size(ids) > 0) & (F.get(ids, F.lit(0)) == bos), 0).otherwise(1) + seps > row_len


def stream_starts(docs: DataFrame, row_len: int, shards: int, seps: int, key: str = "doc_id") -> DataFrame:
    """(key, shard, start): where each document begins in its shard's stream of cells; rows are ``row_len`` cells each.

    Documents go on from row to row. After one up to ``seps`` separators follow, as many as its last row has room for, so a place depends
    on all before it. ``docs`` has key and n; only lengths travel. Empty documents take no place.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, starts = pdf.sort_values("key"), 0, []
        for n in pdf["n"].tolist():
            starts.append(at)
            at += n
            at += min(seps, -at % row_len)
        return pd.DataFrame({"key": pdf["key"], "shard": pdf["shard"], "start": starts})

    dealt = docs.where("n > 0").select(F.col(key).cast("long").alias("key"), F.pmod(F.col(key), F.lit(shards)).cast("long").alias("shard"), F.col("n").cast("long").alias("n"))
    return dealt.groupBy("shard").applyInPandas(run, "key long, shard long, start long").withColumnRenamed("key", key)


_CELL = "struct<id:string,label:boolean,weight:double>"


def _cells(ids: Column, label: Column, weight: Column | None = None) -> Column:
    """Cells of equal label; label and weight are columns or functions of the place."""
    return F.transform(ids, lambda x, i: F.struct(x.alias("id"), (label(i) if callable(label) and not isinstance(label, Column) else label).alias("label"), (F.lit(None).cast("double") if weight is None else weight).alias("weight")))


def _assembled(blocks: DataFrame, row_len: int, pad: str) -> DataFrame:
    """(shard, row, ids, segments, labels, weights) from blocks (shard, row, offset, cells) that lie side by side in their rows.

    Every block is a segment, every padding cell behind the last one another. A label is the id where it is supervised, else null.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "cells")))
    marked = F.flatten(F.transform(ordered, lambda b, k: F.transform(b["cells"], lambda c: F.struct(c["id"].alias("id"), k.alias("segment"), F.coalesce(c["label"], F.lit(False)).alias("label"), F.coalesce(c["weight"], F.lit(0.0)).alias("weight")))))
    rows = blocks.groupBy("shard", "row").agg(marked.alias("c"), F.count("*").cast("int").alias("blocks"))
    room = F.lit(row_len) - F.size("c")
    ids = F.concat(F.transform("c", lambda c: c["id"]), F.array_repeat(F.lit(pad), room))
    tail = F.when(room > 0, F.sequence(F.col("blocks"), F.col("blocks") + room - 1)).otherwise(F.array().cast("array<int>"))
    segments = F.concat(F.transform("c", lambda c: c["segment"]), tail)
    labels = F.concat(F.transform("c", lambda c: F.when(c["label"], c["id"])), F.array_repeat(F.lit(None).cast("string"), room))
    weights = F.concat(F.transform("c", lambda c: c["weight"]), F.array_repeat(F.lit(0.0), room))
    return rows.select("shard", "row", ids.alias("ids"), segments.alias("segments"), labels.alias("labels"), weights.alias("weights"))


def split_rows(docs: DataFrame, row_len: int, shards: int, seps: int, key: str = "doc_id", bos: str = BOS, eos: str = EOS, pad: str = PAD, supervise_eos: bool = True) -> DataFrame:
    """(shard, row, ids, segments, labels, weights) of rows that documents fill one after the other, going on in the next row.

    ``docs`` has key and ids. The part of a document in a row is a block: its first id is not supervised, its others are, and so is the
    end mark right behind the document, the first of its separators; the others are padding. Weights are 0 here.
    """
    started = docs.select(key, with_start(F.col("ids"), bos).alias("ids"))
    placed = started.join(stream_starts(started.select(key, F.size("ids").alias("n")), row_len, shards, seps, key), key)
    end = F.col("start") + F.size("ids")
    rows = placed.select("shard", "start", "ids", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / row_len), F.floor((end - 1) / row_len))).alias("row"))
    first = F.greatest(F.col("row") * row_len, F.col("start"))
    last = F.least((F.col("row") + 1) * row_len, F.col("end"))
    own = F.slice("ids", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    n_seps = F.when(last == F.col("end"), F.least(F.lit(seps), F.pmod(-last, F.lit(row_len)))).otherwise(0).cast("int")
    after = F.when(n_seps > 0, F.concat(F.array(F.lit(eos)), F.array_repeat(F.lit(pad), n_seps - 1))).otherwise(F.array().cast("array<string>"))
    cells = F.concat(_cells(own, lambda i: i > 0), _cells(after, lambda i: (i == 0) & F.lit(supervise_eos)))
    return _assembled(rows.select("shard", "row", (first - F.col("row") * row_len).alias("offset"), cells.cast(f"array<{_CELL}>").alias("cells")), row_len, pad)


def whole_rows(docs: DataFrame, row_len: int, shards: int, seps: int, key: str = "doc_id", bos: str = BOS, pad: str = PAD) -> DataFrame:
    """(shard, row, ids, segments, labels, weights) of rows that hold whole documents, next fit; longer ones are left out.

    ``docs`` has key, ids and mask. Supervised cells weigh 1 / (supervised cells of the document), so documents weigh the same.
    """
    ids = with_start(F.col("ids"), bos)
    mask = F.when(F.size(ids) > F.size("ids"), F.concat(F.array(F.lit(0)), "mask")).otherwise(F.col("mask"))
    started = docs.where(F.size("ids") > 0).select(key, ids.alias("ids"), mask.alias("mask"))
    places = packed_blocks(started.select(key, F.size("ids").alias("n_tokens")), row_len, shards, seps, key=key)
    supervised = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    own = F.zip_with("ids", "mask", lambda i, m: F.struct(i.alias("id"), (m == 1).alias("label"), F.when(m == 1, 1.0 / F.col("k")).alias("weight")))
    after = F.transform(F.array_repeat(F.lit(pad), seps), lambda p: F.struct(p.alias("id"), F.lit(False).alias("label"), F.lit(None).cast("double").alias("weight")))
    blocks = started.withColumn("k", supervised.cast("double")).join(places.select(key, "shard", "row", "offset"), key)
    return _assembled(blocks.select("shard", "row", "offset", F.concat(own.cast(f"array<{_CELL}>"), after.cast(f"array<{_CELL}>")).alias("cells")), row_len, pad)


def evidence_rows(docs: DataFrame, row_len: int, evidence_len: int, shards: int, floor: int = 1, key: str = "doc_id") -> DataFrame:
    """(shard, row, n_docs, evidence, slots, chunks, gold): a row's evidence, its chunks numbered through the row.

    ``docs`` has key, n_tokens, n_supervised and chunks, an array of (ids, gold). Rows close when the tokens or the evidence of the next
    document don't fit. evidence are the ids of all chunks in order, slots and chunks name for each id the document of the row (from 0) and
    the chunk of the row it comes from, and gold has a flag for each chunk.
    """
    sized = docs.withColumn("n_evidence", F.aggregate("chunks", F.lit(0), lambda n, c: n + F.size(c["ids"])))
    places = packed_evidence(sized.select(key, "n_tokens", "n_evidence", "n_supervised"), row_len, evidence_len, shards, floor, key)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "chunks")))
    rows = sized.join(places.select(key, "shard", "row", "offset"), key).groupBy("shard", "row").agg(ordered.alias("d"))
    chunks = F.flatten(F.transform("d", lambda d, slot: F.transform(d["chunks"], lambda c: F.struct(c["ids"].alias("ids"), c["gold"].alias("gold"), slot.alias("slot")))))
    each = lambda value: F.flatten(F.transform("c", value))
    return rows.select("shard", "row", F.size("d").alias("n_docs"), chunks.alias("c")).select(
        "shard", "row", "n_docs", each(lambda c: c["ids"]).alias("evidence"), each(lambda c: F.array_repeat(c["slot"], F.size(c["ids"]))).alias("slots"), each(lambda c, i: F.array_repeat(i, F.size(c["ids"]))).alias("chunks"), F.transform("c", lambda c: c["gold"]).alias("gold")
    )


def span_codes(tokens: Column, spans: Column, codes: dict[str, int], other: int) -> Column:
    """A code for each token of (start, end), ends exclusive: that of the first span that overlaps it, 0 without one.

    Spans are (start, end, label); a label without a code of its own gets ``other``. Empty tokens have none.
    """
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])

    def of(t: Column) -> Column:
        met = F.filter(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]) & (t["end"] > t["start"]))
        return F.when(F.size(met) > 0, F.coalesce(F.try_element_at(code, F.get(met, F.lit(0))["label"]), F.lit(other))).otherwise(0)

    return F.transform(tokens, of)


def token_offsets(text: Column) -> Column:
    """(token, start, end) of the white-space tokens of a text, offsets in characters."""
    parts = F.regexp_extract_all(text, F.lit(r"(\s*)(\S+)"), F.lit(0))
    none = F.array().cast("array<struct<token:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(a: Column, p: Column) -> Column:
        token = F.regexp_replace(p, r"^\s+", "")
        end = a["at"] + F.length(p)
        return F.struct(end.alias("at"), F.array_append(a["found"], F.struct(token.alias("token"), (end - F.length(token)).alias("start"), end.alias("end"))).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def first_run(codes: Column, wanted: list[int]) -> Column:
    """(start, n) of the first run of codes among ``wanted``; start is null and n 0 without one."""
    hit = F.transform(codes, lambda c: c.isin(*wanted))
    at = F.array_position(hit, True)
    rest = F.slice(hit, at.cast("int"), F.size(hit))
    ends = F.array_position(rest, False)
    return F.when(at > 0, F.struct((at - 1).alias("start"), F.when(ends > 0, ends - 1).otherwise(F.size(rest)).cast("long").alias("n"))).otherwise(F.struct(F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("n")))


def fully_supervised(mask: Column, n: int) -> Column:
    """For each place from which n cells follow, whether all of them are supervised."""
    return F.when(F.size(mask) >= n, F.transform(F.sequence(F.lit(1), F.size(mask) - n + 1), lambda i: F.array_min(F.slice(mask, i, n)) == 1)).otherwise(F.array().cast("array<boolean>"))
