"""Token sequence operators: windows, chunks, packing, overlap and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.mixing import running_total
from textloom.sizes import hint

#: Occurrences from which tokens are numbered together.
COMMON = 1 << 20


def windows(docs: DataFrame, width: int, least: int, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, window, start, tokens): consecutive windows of a document, a last one under ``least`` tokens dropped."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    cut = docs.select(key, F.col(tokens).alias("__t"), F.posexplode(starts).alias("window", "start"))
    return cut.select(key, "window", "start", F.slice("__t", F.col("start") + 1, width).alias("tokens")).where(F.size("tokens") >= least)


def framed(tokens: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """(ids, mask) of a window between its marks; only the first mark is unsupervised."""
    ids = F.concat(F.array(F.lit(bos)), tokens, F.array(F.lit(eos)))
    return F.struct(ids.alias("ids"), F.transform(ids, lambda _, i: (i > 0).cast("int")).alias("mask"))


def three_way_split(tokens: Column, cap: int, held: int, chunk: int, least: int = 16, continuation: int = 32) -> Column:
    """(prefix, held, rest, chunks) of a document of up to ``cap`` tokens: a quarter, a fixed span, what follows; null if too short."""
    t = F.slice(tokens, 1, cap)
    first = F.floor(F.least(F.size(tokens), F.lit(cap)) / 4).cast("int")
    span = F.slice(t, first + 1, held)
    rest = F.slice(t, first + held + 1, cap)
    chunks = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(span) - 1, F.lit(0)), F.lit(chunk)), lambda s: F.slice(span, s + 1, chunk)), lambda c: F.size(c) >= least)
    return F.when(F.size(rest) >= continuation, F.struct(F.slice(t, 1, first).alias("prefix"), span.alias("held"), rest.alias("rest"), chunks.alias("chunks")))


def grams(tokens: Column, n: int, stride: int = 1) -> Column:
    """(position, gram) of every ``stride``-th run of n tokens, the gram a joined text so that equality is exact."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.array_join(F.slice(tokens, s + 1, n), " ").alias("gram")))


def vocabulary(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, id, n): the distinct tokens with dense ids from 0, the most frequent first; numbered over ranges of their counts."""
    counts = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # counts alone would leave all that occur once in one bucket, so the code point that a token begins with cuts each further
    first = F.ascii("token")
    # the few tokens that occur more often than COMMON are one bucket, whatever they begin with
    bucket = F.when(F.col("n") < COMMON, first - F.col("n") * (1 << 21)).otherwise(F.lit(-COMMON * (1 << 21)))
    ordered = running_total(counts, bucket, [F.desc("n"), F.col("token")], F.lit(1), "id")
    return ordered.select("token", (F.col("id") - 1).alias("id"), "n")


def with_ids(docs: DataFrame, vocabulary: DataFrame, key: str, tokens: str = "tokens", unknown: int = -1) -> DataFrame:
    """(key, ids): tokens as ids of a vocabulary, ``unknown`` for others; documents without tokens are left out.

    A vocabulary of measured small size is broadcast; beyond it the tokens meet it in a join that adaptive execution can split.
    """
    placed = docs.select(key, F.posexplode(tokens).alias("p", "token")).join(hint(vocabulary.select("token", "id")), "token", "left")
    by = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("x"))
    return by.select(key, F.transform("x", lambda s: s["id"]).alias("ids"))


def gram_hashes(tokens: Column, n: int, stride: int = 1) -> Column:
    """(at, h1, h2) of every ``stride``-th run of n tokens: 128 bits stand for it, so no text of a gram is ever built or shuffled."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.xxhash64(F.slice(tokens, s + 1, n)).alias("h1"), F.xxhash64(F.lit(1), F.slice(tokens, s + 1, n)).alias("h2")))


def overlap_share(clean: DataFrame, train: DataFrame, n: int, stride: int, key: str, mask: str | None = None) -> DataFrame:
    """(key, n_tokens, covered): tokens of each clean document that lie in a gram which some training document has.

    With ``mask`` a training gram counts only if all its tokens are supervised. The training side's grams meet the clean ones (broadcast if
    their bytes are measured to be few) before anything of it is shuffled; only met grams are made distinct.
    """
    tested = clean.select(key, F.explode(gram_hashes(F.col("tokens"), n, stride)).alias("g")).select(key, "g.at", "g.h1", "g.h2")
    grams = gram_hashes(F.col("tokens"), n)
    if mask:
        grams = F.filter(grams, lambda g: F.array_min(F.slice(mask, g["at"] + 1, n)) == 1)
    wanted = tested.select("h1", "h2").distinct()
    seen = train.select(F.explode(grams).alias("g")).select("g.h1", "g.h2").join(hint(wanted), ["h1", "h2"], "left_semi").distinct()
    hit = tested.join(hint(seen), ["h1", "h2"], "left_semi").select(key, F.explode(F.sequence(F.col("at"), F.col("at") + n - 1)).alias("p")).distinct()
    return clean.select(key, F.size("tokens").alias("n_tokens")).join(hit.groupBy(key).agg(F.count("*").alias("covered")), key, "left").fillna(0, ["covered"])


def sequence_counts(docs: DataFrame, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, n): overlapping occurrences of token sequences inside documents; patterns are space-joined and may repeat.

    One pass over the documents takes the runs of every length that a pattern has, as hashes; they meet the patterns where they are read
    (broadcast if their bytes are measured to be few). Occurrences don't cross documents; empty patterns occur nowhere.
    """
    split = F.split(pattern, " ")
    sized = patterns.where(F.col(pattern) != "").select(pattern, F.size(split).alias("len"), F.xxhash64(split).alias("h1"), F.xxhash64(F.lit(1), split).alias("h2")).distinct()
    widths = sorted(r.len for r in sized.select("len").distinct().collect())  # the lengths of a pattern list are few
    if not widths:
        return patterns.select(pattern, F.lit(0).cast("long").alias("n"))
    every = F.concat(*(gram_hashes(F.col("tokens"), n) for n in widths))
    met = docs.select(F.explode(every).alias("g")).select("g.h1", "g.h2").join(hint(sized), ["h1", "h2"]).groupBy(pattern).agg(F.count("*").alias("n"))
    return patterns.join(met, pattern, "left").select(pattern, F.coalesce("n", F.lit(0)).alias("n"))


def _pack(lengths: list[int], row_len: int, seps: int, split: bool) -> list[tuple[int, int, int, int, int]]:
    """(document, row, offset in row, start in document, tokens) of every block.

    Splitting: documents fill rows and go on in the next; up to ``seps`` separators follow a document while there is room. Otherwise next
    fit: a document and its separators open a new row when they don't fit, and one longer than a row is skipped.
    """
    blocks, row, used = [], 0, 0
    for doc, n in enumerate(lengths):
        if split:
            start = 0
            while start < n:
                take = min(n - start, row_len - used)
                blocks.append((doc, row, used, start, take))
                start, used = start + take, used + take
                if used == row_len:
                    row, used = row + 1, 0
            used += min(seps, row_len - used) if used else 0
        else:
            if n + seps > row_len:
                continue
            if used + n + seps > row_len:
                row, used = row + 1, 0
            blocks.append((doc, row, used, 0, n))
            used += n + seps
        if used == row_len:
            row, used = row + 1, 0
    return blocks


def packed_blocks(docs: DataFrame, row_len: int, shards: int, seps: int = 1, split: bool = False, key: str = "doc_id") -> DataFrame:
    """(shard, row, offset, key, start, n): where each document's tokens lie in rows of ``row_len``; ``docs`` has key and n_tokens.

    Packing depends on order, so documents are dealt by key modulo ``shards`` and each shard is packed in key order; the number of shards is
    part of the result. Only lengths travel, never tokens.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        blocks = _pack(pdf["n_tokens"].tolist(), row_len, seps, split)
        keys = pdf["key"].tolist()
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), r, o, keys[d], s, n) for d, r, o, s, n in blocks], columns=["shard", "row", "offset", "key", "start", "n"])

    dealt = docs.select(F.pmod(F.col(key), F.lit(shards)).cast("long").alias("shard"), F.col(key).cast("long").alias("key"), F.col("n_tokens").cast("long").alias("n_tokens"))
    packed = dealt.groupBy("shard").applyInPandas(run, "shard long, row long, offset long, key long, start long, n long")
    return packed.withColumnRenamed("key", key)


def packed_evidence(docs: DataFrame, row_len: int, evidence_len: int, shards: int, floor: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, shard, row, offset, evidence_offset, weight): next fit under two budgets; a row closes when either would overflow.

    ``docs`` has key, n_tokens, n_evidence and n_supervised; one position of a row is kept free, and weight is 1 / max(supervised, floor).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, row, used, evidence = [], 0, 0, 0
        for d in pdf.sort_values("key").itertuples():
            if d.n_tokens > row_len - 1 or d.n_evidence > evidence_len:
                continue
            if used + d.n_tokens > row_len - 1 or evidence + d.n_evidence > evidence_len:
                row, used, evidence = row + 1, 0, 0
            out.append((d.key, d.shard, row, used, evidence, 1.0 / max(d.n_supervised, floor)))
            used, evidence = used + d.n_tokens, evidence + d.n_evidence
        return pd.DataFrame(out, columns=["key", "shard", "row", "offset", "evidence_offset", "weight"])

    dealt = docs.select(F.col(key).cast("long").alias("key"), F.pmod(F.col(key), F.lit(shards)).cast("long").alias("shard"), *(F.col(c).cast("long").alias(c) for c in ("n_tokens", "n_evidence", "n_supervised")))
    return dealt.groupBy("shard").applyInPandas(run, "key long, shard long, row long, offset long, evidence_offset long, weight double").withColumnRenamed("key", key)


def sentence_chunks(docs: DataFrame, cap: int, key: str = "doc_id", sentences: str = "sentences", prefix: str | None = None, least: int = 8) -> DataFrame:
    """(key, chunk, text): whole sentences packed up to ``cap`` tokens; a longer sentence is cut into pieces that stand alone.

    ``prefix`` names a column put in front of every chunk; its tokens and one more are taken off the cap, and less than ``least`` tokens
    left is an error. A text without sentences has no chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, told, before in zip(pdf[key], pdf["sentences"], pdf["prefix"], strict=True):
                room = cap - len(before.split()) - 1 if before else cap
                if room < least:
                    raise ValueError(f"a cap of {cap} leaves {room} tokens beside the prefix {before!r}")
                chunks, open_ = [], []
                for words in (s.split() for s in (told if told is not None else [])):
                    alone = len(words) > room
                    if open_ and (alone or len(open_) + len(words) > room):
                        chunks.append(open_)
                        open_ = []
                    if alone:
                        chunks += [words[i : i + room] for i in range(0, len(words), room)]
                    else:
                        open_ = open_ + words
                chunks += [open_] if open_ else []
                out += [(doc, i, before + " ".join(c)) for i, c in enumerate(chunks)]
            yield pd.DataFrame(out, columns=[key, "chunk", "text"])

    before = F.coalesce(F.col(prefix), F.lit("")) if prefix else F.lit("")
    return docs.select(key, F.col(sentences).alias("sentences"), before.alias("prefix")).mapInPandas(run, f"{key} long, chunk int, text string")
