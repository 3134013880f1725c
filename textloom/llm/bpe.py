"""Byte-level BPE over a rank file, with long texts pre-tokenised in overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised alone; a boundary that both neighbours find in their overlap, with
``GUARD`` characters of text still to come, is where their pre-tokens resynchronise: the pattern looks at no character before a match and
one character behind it, so from there on both would find the same matches. The pieces between such boundaries are encoded and put
together in order. Where an overlap holds no common boundary (one match spans it), the chunks are joined into one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from textloom.llm.batches import bounded
from textloom.storage import stored

#: Characters of a chunk and of the overlap with the one before; texts up to a chunk are encoded at once.
CHUNK, OVERLAP, GUARD = 1 << 15, 1 << 11, 2
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 15


class ByteBpe:
    """Encoder and decoder of one rank file, as the tiktoken library's ``encode_ordinary``."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def _piece(self, token: str) -> list[int]:
        raw = token.encode("utf-8")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else list(self.core.encode_single_piece(raw))
        if len(token) <= 64 and len(self.known) < REMEMBERED:
            self.known[token] = ids
        return ids

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, taken at once."""
        known, piece = self.known, self._piece
        return list(chain.from_iterable([known.get(t) or piece(t) for t in self.pattern.findall(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, chunk: str, start: int, end: int) -> list[int]:
        """Ends of the pre-tokens of ``chunk`` that lie from ``start`` to ``end``."""
        return [at for m in self.pattern.finditer(chunk) if start <= (at := m.end()) <= end]


@lru_cache(maxsize=4)
def _loaded(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def stitch(spans: list[tuple[int, int, list[int], list[int]]], length: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of a text of ``length`` characters from its chunks in order.

    A chunk is (start, end, head, tail): where it lies, and its boundaries in the overlap with the chunk before and with the one after.
    Pieces start where the overlaps agree; chunks whose overlap has no common boundary stay together.
    """
    cuts = [0]
    for before, after in zip(spans, spans[1:], strict=False):
        common = set(before[3]) & set(after[2])
        if common and (at := min(common)) > cuts[-1]:
            cuts.append(at)
    return list(zip(cuts, [*cuts[1:], length], strict=True))


def encode_chunked(bpe: ByteBpe, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The chunked way for one text in one process; equals ``bpe.encode(text)``."""
    spans = []
    for start in range(0, max(1, len(text)), size):
        end = min(len(text), start + size + overlap)
        spans.append(_span(bpe, text[start:end], start, end, size, overlap))
    return [i for a, b in stitch(spans, len(text)) for i in bpe.encode(text[a:b])]


def _span(bpe: ByteBpe, chunk: str, start: int, end: int, size: int, overlap: int) -> tuple[int, int, list[int], list[int]]:
    found = bpe.boundaries(chunk, 0, max(0, len(chunk) - GUARD))
    return start, end, [start + x for x in found if x <= overlap], [start + x for x in found if x >= size]


def _columns(batch: pa.RecordBatch, ids: list[list[int]], tokens: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(tokens, pa.binary())], names=[*batch.schema.names, "ids", "decoded"])


def _digest_row(bpe: ByteBpe, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, decoded) per row, or (doc_id, n_tokens, ids_sha256, decoded_sha256) with ``digests``.

    ``decoded`` are the bytes that the ids decode to. A null text counts as empty and has no ids; repeated rows and null ids are kept row
    by row; an empty table gives an empty one; other columns are never read. Texts of up to ``chunk`` characters are encoded where they are
    read. Each distinct longer one is cut into overlapping chunk rows that any task may pre-tokenise, and only their boundaries in the
    overlaps meet again; the pieces between agreed boundaries are encoded as rows of their own, a text's ids are put together in order
    once, and the rows that share the text are joined to them.
    """
    schema = DIGEST if digests else "ids array<int>, decoded binary"
    base = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows(key: pa.Field, keys: list, all_ids: list[list[int]]) -> pa.RecordBatch:
        bpe = _loaded(rank_file, pattern)
        if digests:
            cols = zip(*(_digest_row(bpe, ids) for ids in all_ids), strict=True) if all_ids else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(keys, key.type), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True))], names=[key.name, "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([pa.array(keys, key.type), pa.array(all_ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in all_ids], pa.binary())], names=[key.name, "ids", "decoded"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield rows(pa.field("doc_id", pa.int64()), part.column(0).to_pylist(), [bpe.encode(t.as_py()) for t in part.column(1)])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(rank_file, pattern)
        for batch in batches:
            found = [_span(bpe, t.as_py(), s, s + len(t.as_py()), chunk, overlap) for s, t in zip(batch.column("start").to_pylist(), batch.column("part"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("n"), *(pa.array([f[k] for f in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.list_(pa.int64())), (3, pa.list_(pa.int64()))))],
                names=["row", "n", "start", "end", "head", "tail"],
            )

    def pieces(spans_of_row: pa.Table) -> pa.Table:
        t = spans_of_row.sort_by("start")
        cut = stitch(list(zip(*(t.column(c).to_pylist() for c in ("start", "end", "head", "tail")), strict=True)), t.column("n")[0].as_py())
        return pa.table({"row": pa.array([t.column("row")[0].as_py()] * len(cut), pa.string()), "a": pa.array([a for a, _ in cut], pa.int64()), "b": pa.array([b for _, b in cut], pa.int64())})

    def piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(rank_file, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bpe.encode(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))], names=["row", "a", "ids"])

    def joined(of_row: pa.Table) -> pa.Table:
        t = of_row.sort_by("a")
        return pa.Table.from_batches([rows(pa.field("row", pa.string()), [t.column("row")[0].as_py()], [list(chain.from_iterable(t.column("ids").to_pylist()))])])

    n = F.length("text")
    short = base.where(n <= chunk).mapInArrow(whole, f"doc_id long, {schema}")
    long_rows = base.where(n > chunk).withColumn("row", F.sha2("text", 256))
    texts = stored(long_rows.select("row", "text").dropDuplicates(["row"]), "long-texts")
    starts = F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk)).cast("array<long>"))
    parts = texts.select("row", n.cast("long").alias("n"), starts.alias("start"), "text").select("row", "n", "start", F.expr(f"substring(text, cast(start + 1 as int), {chunk + overlap})").alias("part"))
    found = parts.mapInArrow(spans, "row string, n long, start long, end long, head array<long>, tail array<long>")
    cut = found.groupBy("row").applyInArrow(pieces, "row string, a long, b long")
    ids = texts.join(cut, "row").select("row", "a", F.expr("substring(text, cast(a + 1 as int), cast(b - a as int))").alias("piece")).mapInArrow(piece_ids, "row string, a long, ids array<int>")
    whole_long = stored(ids.groupBy("row").applyInArrow(joined, f"row string, {schema}"), "long-ids")
    return short.unionByName(long_rows.select("doc_id", "row").join(whole_long, "row").drop("row"))
