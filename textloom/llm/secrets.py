"""Secret scan: fixed patterns, and tokens that zstandard can't foretell from the code around them."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from random import Random

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from textloom.llm.batches import bounded

#: The base kinds in listed order, their patterns, and the least length of the group that counts.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
KINDS = (*(kind for kind, *_ in BASE), "novel")

#: What code around a credential usually says; the primer of the compressor.
PRIMER = (
    "import export from return const let var function class public private static final def self this null none true false "
    "string int float boolean bytes list dict array object config settings options environment variable default value name "
    "username user email host hostname port database connection server client request response header authorization bearer "
    "basic content type application json http https www com org net api version path url uri query param endpoint region "
    "bucket account service client_id client_secret access_key secret_key private_key public_key api_key auth_token "
    "access_token refresh_token session_id credential password passwd pwd key token secret signature certificate "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example sample test dummy placeholder changeme"
)
#: Characters before and after a candidate that it is measured against; the sensitive word must be among those before.
BEFORE, AFTER = 64, 32
LEAST = 16
#: Share of the marginal compressed bytes of random strings (of its length and alphabet, in its place) from which a candidate counts as
#: incompressible, and the random strings drawn.
NOVELTY, DRAWS = 0.8, 4
#: Alphabets of letters and digits; a candidate has the first that holds all of them. Its other characters stay where they are.
ALPHABETS = tuple(
    "".join(chr(c) for c in range(128) if re.match(f"[{x}]", chr(c)))
    for x in ("0-9", "0-9a-f", "0-9A-F", "a-z", "A-Z", "A-Z2-7", "a-z2-7", "0-9a-z", "0-9A-Z", "A-Za-z", "A-Za-z0-9")
)
#: Pairs of letters common in words; a candidate mostly of letters, with this share of its pairs among them, is made of words.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ri io ic me co ne "
    "us li la el ch ce ma ro ll no di ec om em ta ie ns ac be so ca il ot tr ss pe ho ai un po ee ut wi lo na us sh ad qu ue am ge ct id "
    "os ir ol mi ei ni ui lu pr pl ke ey ag ul im ab tu su mo do vi op iv do da ap ig da cl ck gh".split()
)
WORDLIKE, LETTERS = 0.5, 0.75
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_SENSITIVE = re.compile(r"(?ai:key|token|secret|passw|pwd|credential|auth|bearer|signature|private)")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

_SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping within a kind, those too short dropped."""
    found, low = [], text.lower()
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(w in low for w in _ASSIGN_WORDS):
            continue
        if kind == "access" and "AKIA" not in text:
            continue
        if kind == "hex":  # a run is one match, so runs long enough can be sought at once
            found += [(kind, *m.span()) for m in _LONG_HEX.finditer(text)]
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % BASE[2][3])


def wordlike(token: str) -> bool:
    """Whether a token is mostly letters, in pairs that words are made of; the compressor can't know words that its primer lacks."""
    runs = re.findall("[a-z]+", token.lower())
    pairs = [r[i : i + 2] for r in runs for i in range(len(r) - 1)]
    return sum(map(len, runs)) >= LETTERS * sum(c.isalnum() for c in token) and sum(p in PAIRS for p in pairs) >= WORDLIKE * len(pairs)


class Novelty:
    """Marginal compressed size of a token inside its surroundings, over a compressor primed with identifiers."""

    def __init__(self, primer: str = PRIMER, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.packer.compress(text.encode("utf-8", "replace")))

    def marginal(self, text: str, start: int, end: int, token: str | None = None) -> int:
        """Bytes that the token, or another in its place, adds to the compressed surroundings."""
        before, token, after = text[max(0, start - BEFORE) : start], token or text[start:end], text[end : end + AFTER]
        return self.size(before + token + after) - self.size(before + after)

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal bytes of the token over those of random strings of its shape, so that fixed costs and small alphabets cancel out."""
        token = text[start:end]
        own = {c for c in token if c.isalnum()}
        alphabet = next(a for a in ALPHABETS if own <= set(a))
        rng = Random(zlib.crc32(token.encode()))
        drawn = ["".join(rng.choice(alphabet) if c.isalnum() else c for c in token) for _ in range(DRAWS)]
        return DRAWS * self.marginal(text, start, end) / max(1, sum(self.marginal(text, start, end, t) for t in drawn))

    def spans(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Incompressible tokens in a sensitive context that no base span covers in part."""
        found, starts, reach = [], [], []
        for a, b in sorted((a, b) for _, a, b in taken):
            starts.append(a)
            reach.append(max(b, reach[-1]) if reach else b)  # the furthest end of a span that starts here or before
        for m in _CANDIDATE.finditer(text):
            start, end = m.span()
            if not any(c.isalnum() for c in m[0]) or not _SENSITIVE.search(text, max(0, start - BEFORE), start):
                continue
            before = bisect_left(starts, end)
            if before and reach[before - 1] > start:
                continue
            if not wordlike(m[0]) and self.novelty(text, start, end) >= NOVELTY:
                found.append(("novel", start, end))
        return found


def secret_spans(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed; offsets in code points, ends exclusive."""
    base = base_spans(text)
    return sorted(base + novelty.spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row, spans an array of (kind, start, end).

    Kinds are assign, access, hex (fixed patterns) and novel (found by marginal compressed size). A null text counts as empty and has no
    spans; repeated rows and null ids are kept row by row; other columns are never read. Work is one pass where the rows are read, with no
    shuffle, and holds one text at a time.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t.as_py() or "", novelty)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scanned, f"doc_id long, spans {_SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of a scan's spans, a row for each row; without spans the counts are zero and the digest that of no text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), counts[3])
