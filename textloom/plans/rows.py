"""Queries that pack, window and mark token rows; oracles replay the packing with recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import text as T
from textloom.operators import chat, mixing, rows as P, tokens
from textloom.plans import renders as Q
from textloom.plans.corpus import DOC_TOKENS, DRAW, documents, lengths
from textloom.plans.registry import register
from textloom.storage import table

ROW, SHARDS, SEPS = 256, 8, 3


def _token_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ids; every seventh begins with the start mark already."""
    marked = F.when((F.col("doc_id") % 7 == 0) & (F.size("tokens") > 0), F.concat(F.array(F.lit(P.BOS)), "tokens")).otherwise(F.col("tokens"))
    return documents(spark, sf).select("doc_id", marked.alias("ids"))


#: Documents with the start mark, numbered in their shard.
_IDS = f"SELECT doc_id, doc_id % {SHARDS} AS shard, list_concat(['<s>'], {DOC_TOKENS}) AS t FROM documents WHERE len({DOC_TOKENS}) > 0"
_STREAM = f"""
d AS (SELECT *, len(t) AS n, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS k FROM ({_IDS})),
p AS (SELECT shard, 1::BIGINT AS k, 0::BIGINT AS start FROM (SELECT DISTINCT shard FROM d)
      UNION ALL SELECT p.shard, p.k + 1, start + n + least({SEPS}, ({ROW} - (start + n) % {ROW}) % {ROW}) FROM p JOIN d ON d.shard = p.shard AND d.k = p.k),
s AS (SELECT d.shard, d.t, d.n, p.start, p.start + d.n AS stop FROM p JOIN d ON d.shard = p.shard AND d.k = p.k)"""


@register("split_rows", f"""
WITH RECURSIVE {_STREAM},
b AS (SELECT *, greatest(r * {ROW}, start) AS a, least((r + 1) * {ROW}, stop) AS z FROM (SELECT *, unnest(range(start // {ROW}, (stop - 1) // {ROW} + 1)) AS r FROM s)),
c AS (SELECT shard, r, a, z, t[a - start + 1:z - start] AS own, CASE WHEN z = stop THEN least({SEPS}, ({ROW} - z % {ROW}) % {ROW}) ELSE 0 END AS e FROM b),
f AS (SELECT shard, r AS "row", flatten(list(list_concat(own, ['</s>', '<pad>', '<pad>'][1:e]) ORDER BY a)) AS ids, sum(len(own) - 1 + (e > 0)::INT)::BIGINT AS n_labels, count(*) AS blocks,
      sum(len(own) - 1 + (e > 0)::INT + 0 * e)::BIGINT AS x FROM c GROUP BY ALL)
SELECT shard, "row", sha1(array_to_string(list_concat(ids, [ '<pad>' for i in range(0, {ROW} - len(ids))]), ' ')) AS ids, n_labels, (blocks - 1 + {ROW} - len(ids))::INT AS last_segment FROM f""")  # fmt: skip
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = P.split_rows(_token_docs(spark, sf), ROW, SHARDS, SEPS)
    n_labels = F.size(F.filter("labels", lambda x: x.isNotNull())).cast("long")
    return found.select("shard", "row", F.sha1(F.array_join("ids", " ").cast("binary")).alias("ids"), n_labels.alias("n_labels"), F.element_at("segments", -1).alias("last_segment"))


@register("packed_split", f"""
WITH RECURSIVE d AS (SELECT doc_id, doc_id % {SHARDS} AS shard, len({DOC_TOKENS}) AS n FROM documents WHERE len({DOC_TOKENS}) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS k FROM d),
p AS (SELECT shard, 1::BIGINT AS k, 0::BIGINT AS start FROM (SELECT DISTINCT shard FROM k) UNION ALL SELECT p.shard, p.k + 1, start + n + least(2, (1024 - (start + n) % 1024) % 1024) FROM p JOIN k ON k.shard = p.shard AND k.k = p.k),
b AS (SELECT k.doc_id, k.shard, start, start + n AS stop, unnest(range(start // 1024, (start + n - 1) // 1024 + 1)) AS r FROM p JOIN k ON k.shard = p.shard AND k.k = p.k)
SELECT shard, r AS "row", greatest(r * 1024, start) % 1024 AS "offset", doc_id, greatest(r * 1024, start) - start AS start, least((r + 1) * 1024, stop) - greatest(r * 1024, start) AS n FROM b""")  # fmt: skip
def packed_split(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.packed_blocks(lengths(spark, sf).select("doc_id", "n_tokens"), 1024, 8, seps=2, split=True)


def _next_fit(row: int, seps: int, source: str) -> str:
    """Recursive SQL (doc_id, shard, row, offset) of a next fit over (doc_id, shard, n), longer documents left out."""
    return f"""nk AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS k FROM ({source}) WHERE n + {seps} <= {row}),
nf AS (SELECT doc_id, shard, k, n, 0::BIGINT AS "row", 0::BIGINT AS "offset" FROM nk WHERE k = 1
       UNION ALL SELECT nk.doc_id, nk.shard, nk.k, nk.n, CASE WHEN nf."offset" + nf.n + {seps} + nk.n + {seps} > {row} THEN nf."row" + 1 ELSE nf."row" END, CASE WHEN nf."offset" + nf.n + {seps} + nk.n + {seps} > {row} THEN 0 ELSE nf."offset" + nf.n + {seps} END
       FROM nf JOIN nk ON nk.shard = nf.shard AND nk.k = nf.k + 1)"""


@register("packed_next_fit", f"""
WITH RECURSIVE {_next_fit(2048, 1, f'SELECT doc_id, doc_id % 8 AS shard, len({DOC_TOKENS}) AS n FROM documents')} SELECT shard, "row", "offset", doc_id, 0::BIGINT AS start, n::BIGINT AS n FROM nf""")  # fmt: skip
def packed_next_fit(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.packed_blocks(lengths(spark, sf).select("doc_id", "n_tokens"), 2048, 8)


_TURNS = "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IS NOT NULL AND " + Q.strip_sql("coalesce(text, '')") + " <> ''"
#: (conv_id, ids, mask) of the conversations that can be encoded.
ENCODED = f"""SELECT conv_id, list_concat(['<s>'], flatten(list(list_concat(['<|' || role || '|>'], w, CASE WHEN role = 'assistant' THEN ['</s>'] ELSE [] END) ORDER BY turn))) AS ids,
 list_concat([0], flatten(list(list_concat([0], [CASE WHEN role = 'assistant' THEN 1 ELSE 0 END for x in w], CASE WHEN role = 'assistant' THEN [1] ELSE [] END) ORDER BY turn))) AS mask
 FROM (SELECT *, {DOC_TOKENS} AS w FROM ({_TURNS})) GROUP BY conv_id HAVING bool_and(role IN ('system', 'user', 'assistant')) AND bool_or(role = 'assistant')"""


def encoded_chats(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, ids, mask) of the conversations that can be encoded."""
    got = chat.conversations(table(spark, sf, "conversations")).where(chat.valid(F.col("turns"))).select("conv_id", chat.encoded(F.col("turns")).alias("x"))
    return got.select("conv_id", F.transform("x", lambda t: t["id"]).alias("ids"), F.transform("x", lambda t: t["mask"]).alias("mask"))


@register("whole_rows", f"""
WITH RECURSIVE e AS ({ENCODED}), {_next_fit(512, 2, 'SELECT conv_id AS doc_id, conv_id % 4 AS shard, len(ids) AS n FROM e')},
b AS (SELECT nf.shard, nf."row", nf."offset", list_concat(e.ids, ['<pad>', '<pad>']) AS ids, list_sum(e.mask) AS k FROM nf JOIN e ON e.conv_id = nf.doc_id)
SELECT shard, "row", sha1(array_to_string(list_concat(flatten(list(ids ORDER BY "offset")), ['<pad>' for i in range(0, 512 - sum(len(ids)))]), ' ')) AS ids, sum(k)::BIGINT AS n_labels, count(*)::DOUBLE AS weight,
(count(*) - 1 + 512 - sum(len(ids)))::INT AS last_segment FROM b GROUP BY ALL""".replace("['<pad>' for i in range(0, 512 - sum(len(ids)))]", "list_resize([]::VARCHAR[], (512 - sum(len(ids)))::BIGINT, '<pad>')"))  # fmt: skip
def whole_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = P.whole_rows(encoded_chats(spark, sf), 512, 4, 2, key="conv_id")
    weight = F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), 6)
    return found.select("shard", "row", F.sha1(F.array_join("ids", " ").cast("binary")).alias("ids"), F.size(F.filter("labels", lambda x: x.isNotNull())).cast("long").alias("n_labels"), weight.alias("weight"), F.element_at("segments", -1).alias("last_segment"))


_EV = f"SELECT doc_id, doc_id % 8 AS shard, len({DOC_TOKENS}) AS n, len({DOC_TOKENS}) % 97 AS ev, len({DOC_TOKENS}) // 2 AS sup FROM documents"


def _evidence_fit(row: int, evidence: int, source: str) -> str:
    return f"""ek AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS k FROM ({source}) WHERE n <= {row - 1} AND ev <= {evidence}),
ef AS (SELECT doc_id, shard, k, n, ev, sup, 0::BIGINT AS "row", 0::BIGINT AS "offset", 0::BIGINT AS eo FROM ek WHERE k = 1
  UNION ALL SELECT ek.doc_id, ek.shard, ek.k, ek.n, ek.ev, ek.sup, ef."row" + (ef."offset" + ef.n + ek.n > {row - 1} OR ef.eo + ef.ev + ek.ev > {evidence})::INT,
  CASE WHEN ef."offset" + ef.n + ek.n > {row - 1} OR ef.eo + ef.ev + ek.ev > {evidence} THEN 0 ELSE ef."offset" + ef.n END, CASE WHEN ef."offset" + ef.n + ek.n > {row - 1} OR ef.eo + ef.ev + ek.ev > {evidence} THEN 0 ELSE ef.eo + ef.ev END
  FROM ef JOIN ek ON ek.shard = ef.shard AND ek.k = ef.k + 1)"""


@register("packed_evidence", f"""WITH RECURSIVE {_evidence_fit(2048, 256, _EV)} SELECT doc_id, shard, "row", "offset", eo AS evidence_offset, 1.0 / greatest(sup, 1) AS weight FROM ef""")
def packed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    sized = lengths(spark, sf).select("doc_id", "n_tokens", F.pmod("n_tokens", F.lit(97)).alias("n_evidence"), (F.col("n_tokens") / 2).cast("long").alias("n_supervised"))
    return tokens.packed_evidence(sized, 2048, 256, 8)


_CHUNKED = f"SELECT doc_id, doc_id % 4 AS shard, len(t) AS n, len(t) // 2 AS sup, list_filter([t[1:8], t[9:14], t[15:17]], lambda c: len(c) > 0) AS cs, len(t[1:17]) AS ev FROM (SELECT doc_id, {DOC_TOKENS} AS t FROM documents)"


@register("evidence_tensors", f"""
WITH RECURSIVE {_evidence_fit(1024, 100, _CHUNKED)},
b AS (SELECT ef.shard, ef."row", ef."offset", row_number() OVER (PARTITION BY ef.shard, ef."row" ORDER BY ef."offset", ef.doc_id) - 1 AS slot, c.cs FROM ef JOIN ({_CHUNKED}) c USING (doc_id)),
u AS (SELECT shard, "row", slot, unnest(cs) AS ids, unnest(range(0, len(cs))) AS i FROM b WHERE len(cs) > 0), n AS (SELECT *, row_number() OVER (PARTITION BY shard, "row" ORDER BY slot, i) - 1 AS c FROM u),
g AS (SELECT shard, "row", sha1(array_to_string(flatten(list(ids ORDER BY c)), ' ')) AS evidence, sum(len(ids) * slot)::BIGINT AS slots, sum(len(ids) * c)::BIGINT AS chunks, count(*) FILTER (i = 0) AS gold FROM n GROUP BY ALL)
SELECT r.shard, r."row", r.n_docs::INT AS n_docs, coalesce(evidence, sha1('')) AS evidence, coalesce(slots, 0) AS slots, coalesce(chunks, 0) AS chunks, coalesce(gold, 0)::INT AS gold FROM (SELECT shard, "row", count(*) AS n_docs FROM b GROUP BY ALL) r LEFT JOIN g ON g.shard = r.shard AND g."row" = r."row\"""")  # fmt: skip
def evidence_tensors(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.filter(F.array(*(F.slice("tokens", a, n) for a, n in ((1, 8), (9, 6), (15, 3)))), lambda c: F.size(c) > 0)
    docs = documents(spark, sf).select("doc_id", F.col("n_tokens"), (F.col("n_tokens") / 2).cast("long").alias("n_supervised"), F.transform(cut, lambda c, i: F.struct(c.alias("ids"), (i == 0).alias("gold"))).alias("chunks"))
    found = P.evidence_rows(docs, 1024, 100, 4)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("shard", "row", "n_docs", F.sha1(F.array_join("evidence", " ").cast("binary")).alias("evidence"), total("slots").alias("slots"), total("chunks").alias("chunks"), F.size(F.filter("gold", lambda g: g)).alias("gold"))


_BIO = "SELECT key, text, spans FROM ({0})"
_CODES = {a: i + 1 for i, a in enumerate(Q.TEMPLATES)}


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """(key, tokens, codes) of every biography: attribute codes from 1, 6 on names."""
    x = Q.R.biography(F.col("key"), F.col("name"), F.col("pronoun"), {a: F.col(a) for a in Q.TEMPLATES}, Q.TEMPLATES)
    marked = Q.people(spark, sf).select("key", x.alias("x")).select("key", P.token_offsets(F.col("x.text")).alias("tokens"), F.col("x.spans").alias("spans"))
    return marked.select("key", "tokens", P.span_codes(F.col("tokens"), F.col("spans"), _CODES, 6).alias("codes"))


#: (key, codes) of every biography, from the oracle of the biographies themselves.
CODED = f"""
SELECT key, list(coalesce((SELECT CASE s.l WHEN 'city' THEN 1 WHEN 'region' THEN 2 WHEN 'trade' THEN 3 ELSE 6 END FROM (SELECT unnest(sp) AS s) WHERE s.a < t.z AND t.a < s.z ORDER BY s.a LIMIT 1), 0) ORDER BY t.a) AS codes FROM (
 SELECT key, sp, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x) + 1)), 0)::INT, 'z': coalesce(list_sum(list_transform(w[:i - 1], lambda x: length(x) + 1)), 0)::INT + length(w[i])}})) AS t
 FROM (SELECT key, string_split(text, ' ') AS w, list_transform(string_split(spans, ' '), lambda s: {{'a': string_split(string_split(s, ':')[1], '-')[1]::INT, 'z': string_split(string_split(s, ':')[1], '-')[2]::INT, 'l': string_split(s, ':')[2]}}) AS sp FROM bios)) GROUP BY key"""


def _bios_sql() -> str:
    from textloom.plans.registry import ORACLES

    return ORACLES["biographies"]


@register("span_codes", f"WITH bios AS ({_bios_sql()}) SELECT key, array_to_string(codes, '') AS codes FROM ({CODED})")
def span_codes(spark: SparkSession, sf: str) -> DataFrame:
    return coded(spark, sf).select("key", F.array_join(F.transform("codes", lambda c: c.cast("string")), "").alias("codes"))


@register("first_mentions", f"""
WITH bios AS ({_bios_sql()}), c AS (SELECT key, array_to_string(codes, '') AS codes FROM ({CODED})) SELECT key, (strpos(codes, '6') - 1)::BIGINT AS start, length(regexp_extract(codes, '6+'))::BIGINT AS n FROM c""")  # fmt: skip
def first_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return coded(spark, sf).select("key", P.first_run(F.col("codes"), [6]).alias("x")).select("key", "x.start", "x.n")


@register("supervised_runs", f"WITH e AS ({ENCODED}) SELECT conv_id, len([i for i in range(1, len(mask) - 6) if list_min(mask[i:i + 7]) = 1])::INT AS runs FROM e")
def supervised_runs(spark: SparkSession, sf: str) -> DataFrame:
    return encoded_chats(spark, sf).select("conv_id", F.size(F.filter(P.fully_supervised(F.col("mask"), 8), lambda x: x)).alias("runs"))


@register("chat_prompt", f"""
WITH t AS (SELECT *, max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM (SELECT *, {DOC_TOKENS} AS w FROM ({_TURNS})))
SELECT conv_id, array_to_string(list_concat(['<s>'], coalesce(flatten(list(list_concat(['<|' || role || '|>'], w, CASE WHEN role = 'assistant' THEN ['</s>'] ELSE [] END) ORDER BY turn) FILTER (turn <= last)), []), ['<|assistant|>']), ' ') AS ids FROM t GROUP BY conv_id""")  # fmt: skip
def chat_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return chat.conversations(table(spark, sf, "conversations")).select("conv_id", F.array_join(chat.prompt(F.col("turns")), " ").alias("ids")).where("ids <> '<s> <|assistant|>' OR conv_id IS NOT NULL")


@register("end_marks", f"""
WITH e AS ({ENCODED}), m AS (SELECT conv_id, ids, mask, [i for i in range(1, len(ids) + 1) if ids[i] = '<|assistant|>'] AS marks FROM e)
SELECT conv_id, len(marks)::INT AS turns, len([p for p in marks if coalesce(mask[p + list_position(ids[p + 1:], '</s>')], 0) <> 1])::INT AS bad, ids[-1] <> '</s>' AS open FROM m""")  # fmt: skip
def end_marks(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.filter(F.transform("ids", lambda x, i: F.when(x == "<|assistant|>", i + 1)), lambda i: i.isNotNull())
    closes = lambda p: F.get("mask", p + F.array_position(F.slice("ids", p + 1, F.size("ids")), "</s>").cast("int") - 1)
    bad = F.filter(marks, lambda p: F.coalesce(closes(p), F.lit(0)) != 1)
    return encoded_chats(spark, sf).select("conv_id", F.size(marks).alias("turns"), F.size(bad).alias("bad"), (F.element_at("ids", -1) != "</s>").alias("open"))


@register("passage_chunks", f"SELECT doc_id, unnest(range(0, greatest((len(t) + 99) // 100, 0)))::INT AS chunk, least(100, len(t) - 100 * unnest(range(0, greatest((len(t) + 99) // 100, 0))))::INT AS n FROM (SELECT doc_id, {DOC_TOKENS} AS t FROM documents)")
def passage_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.windows(documents(spark, sf), 100, 1).select("doc_id", F.col("window").alias("chunk"), F.size("tokens").alias("n"))


@register("rank_shards", "SELECT (position % 12) // 4 AS worker, position % 4 AS rank, count(*) AS n, min(position)::BIGINT AS first FROM (SELECT row_number() OVER (ORDER BY sha1('7:' || doc_id), doc_id) - 1 AS position FROM documents) WHERE position >= 30 GROUP BY ALL")
def rank_shards(spark: SparkSession, sf: str) -> DataFrame:
    from textloom.operators.relations import epoch_order

    ordered = epoch_order(table(spark, sf, "documents").select("doc_id"), "doc_id", F.lit(False), 7).select((F.col("position") - 1).alias("position")).where("position >= 30")
    stream = F.pmod("position", F.lit(12))
    return ordered.groupBy(F.floor(stream / 4).alias("worker"), F.pmod(stream, F.lit(4)).alias("rank")).agg(F.count("*").alias("n"), F.min("position").alias("first"))


_WINDOWS = f"SELECT doc_id, unnest(range(0, len(t), 64)) AS start, least(64, len(t) - unnest(range(0, len(t), 64))) AS n FROM (SELECT doc_id, {DOC_TOKENS} AS t FROM documents)"


def filler_windows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, start, n): windows of up to 64 tokens, short last ones left out."""
    return tokens.windows(documents(spark, sf), 64, 32).select("doc_id", F.col("start").cast("long").alias("start"), F.size("tokens").alias("n"))


@register("text_to_target", f"""
WITH w AS (SELECT *, sum(n + 2) OVER (ORDER BY doc_id, start) AS total FROM ({_WINDOWS}) WHERE n >= 32) SELECT doc_id, start, n::INT AS n, total::BIGINT AS total FROM w WHERE total - n - 2 < 50000""")  # fmt: skip
def text_to_target(spark: SparkSession, sf: str) -> DataFrame:
    summed = mixing.running_total(filler_windows(spark, sf), F.floor(F.col("doc_id") / 64), [F.col("doc_id"), F.col("start")], F.col("n") + 2, "total")
    return summed.where(F.col("total") - F.col("n") - 2 < 50_000).select("doc_id", "start", "n", "total")


@register("filler_passes", f"""
WITH w AS (SELECT doc_id, start, n, pass, sha1('3:' || pass || ':' || doc_id || ':' || start) AS h FROM ({_WINDOWS}), (SELECT unnest([1, 2, 3]) AS pass) WHERE n >= 32),
t AS (SELECT *, sum(n + 2) OVER (ORDER BY pass, h, doc_id, start) AS total, sum(n + 2) OVER (PARTITION BY pass) AS available FROM w), k AS (SELECT * FROM t WHERE total - n - 2 < available * 1.5)
SELECT pass, count(*) AS windows, sum(n + 2)::BIGINT AS tokens, round(sum(sum(n + 2)) OVER () / least(sum(sum(n + 2)) OVER (), any_value(available)), 6) AS repeats FROM k GROUP BY pass""")  # fmt: skip
def filler_passes(spark: SparkSession, sf: str) -> DataFrame:
    windows = filler_windows(spark, sf)
    available = windows.agg(F.sum(F.col("n") + 2)).first()[0] or 0
    return mixing.filler(windows, ["doc_id", "start"], F.col("n") + 2, int(available * 1.5 + 0.5), available, 3)


_SENTENCES = """list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([.!?]["''”’)\\]]?)[ \\t\\r\\f]+(["''“‘(\\[\\p{Lu}\\p{N}])', E'\\\\1\\n\\\\2', 'g'), '([.!?]["''”’)\\]]?)[ \\t\\r\\f]+(["''“‘(\\[\\p{Lu}\\p{N}])', E'\\\\1\\n\\\\2', 'g'), '\\n+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"""


@register("sentence_counts", f"SELECT doc_id, len({_SENTENCES})::INT AS n, sha1(array_to_string({_SENTENCES}, '|')) AS digest FROM documents")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    told = table(spark, sf, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return told.select("doc_id", F.size("s").alias("n"), F.sha1(F.array_join("s", "|").cast("binary")).alias("digest"))


_BUDGET = 30
_UNITS = f"""
s AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, string_split_regex(unnest(ss), '\\s+') AS w FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents))),
u AS (SELECT doc_id, i, j, w[j + 1:j + {_BUDGET}] AS w, len(w) > {_BUDGET} AS alone FROM (SELECT *, unnest(range(0, len(w), CASE WHEN len(w) > {_BUDGET} THEN {_BUDGET} ELSE len(w) END)) AS j FROM s)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM u),
c AS (SELECT doc_id, k, len(w) AS n, alone, 0 AS chunk FROM k WHERE k = 1 UNION ALL
      SELECT k.doc_id, k.k, CASE WHEN k.alone OR c.alone OR c.n + len(k.w) > {_BUDGET} THEN len(k.w) ELSE c.n + len(k.w) END, k.alone, c.chunk + (k.alone OR c.alone OR c.n + len(k.w) > {_BUDGET})::INT FROM c JOIN k ON k.doc_id = c.doc_id AND k.k = c.k + 1)"""


@register("sentence_chunks", f"""WITH RECURSIVE {_UNITS} SELECT doc_id, chunk::INT AS chunk, source || ': ' || string_agg(array_to_string(w, ' '), ' ' ORDER BY k) AS text FROM c JOIN k USING (doc_id, k) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY doc_id, chunk, source""")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("sentences"), F.concat("source", F.lit(": ")).alias("prefix"))
    return tokens.sentence_chunks(docs, _BUDGET + 2, prefix="prefix")


@register("crc_validation_split", None)
def crc_validation_split(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws(":", F.lit("42"), "source", F.col("doc_id").cast("string")).cast("binary")
    return table(spark, sf, "documents").select("doc_id", (F.pmod(F.crc32(key), F.lit(1_000_000)) < 50_000).alias("val"))


def _crc_table() -> list[int]:
    """Remainders of all bytes under the CRC-32 polynomial."""
    found = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        found.append(byte)
    return found


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT for c in string_split({text}, '')]), lambda c, b: xor(c >> 8, {_crc_table()}[xor(c & 255, b) + 1]::BIGINT)), 4294967295)"


register("crc_validation_split", "SELECT doc_id, " + crc_sql("'42:' || source || ':' || doc_id") + " % 1000000 < 50000 AS val FROM documents")(crc_validation_split)


@register("weighted_draw_table", f"SELECT doc_id, floor({DRAW.format("'9:' || doc_id")} * 4)::INT AS bin FROM documents")
def weighted_draw_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.floor(T.draw(9, F.col("doc_id")) * 4).cast("int").alias("bin"))
