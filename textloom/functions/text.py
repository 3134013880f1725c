"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: ASCII punctuation that answers are compared without, and the articles dropped from them.
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
ARTICLES = ("a", "an", "the")
#: Stratum bounds of a frequency.
STRATA = ((0, "0"), (9, "1-9"), (99, "10-99"), (999, "100-999"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; inside a lambda a plain column would be computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """A text without the white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Whitespace tokens; a null or blank text has none."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the text's SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the identity only; both engines can compute it."""
    key = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def order_key(seed: int, *parts: Column) -> Column:
    """A hash that orders rows as a seeded shuffle."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, spaces collapsed."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def light_normalize(text: Column) -> Column:
    """Lower case, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def contains_answer(text: Column, answer: Column) -> Column:
    """Whole-word containment of the normalised answer; an empty answer is never contained."""
    padded = lambda c: F.concat(F.lit(" "), normalize_answer(c), F.lit(" "))
    return (normalize_answer(answer) != "") & F.contains(padded(text), padded(answer))


def is_abstention(text: Column, phrases: list[str]) -> Column:
    """Whether a text opens with a phrase of the closed set, or is (12+ characters of) the opening of one; closing . and ! don't count."""
    said = F.regexp_replace(light_normalize(F.coalesce(text, F.lit(""))), "[.!]+$", "")
    known = [" ".join(p.lower().split()).rstrip(".!") for p in phrases]
    opens = [F.startswith(said, F.lit(p)) | ((F.length(said) >= 12) & F.startswith(F.lit(p), said)) for p in known]
    return reduce(lambda a, b: a | b, opens, F.lit(False))


def split_sentences(text: Column) -> Column:
    """Sentences: a text ends one at a line break, and at white space after . ! or ? where a capital, digit, quote or open bracket follows.

    A quote or bracket that closes after the mark belongs to the sentence before.
    """
    ends, opens = "[.!?]", """["'“‘(\\[\\p{Lu}\\p{N}]"""
    closed = ends + """["'”’)\\]]"""
    parts = F.split(text, rf"\n+|(?:(?<={ends})|(?<={closed}))\s+(?={opens})")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _quoted(term: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in term)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term, quoted, stands in a text as whole words, ignoring case; an empty or null term never does."""
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(term, r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"(?!\w)"))
    return F.when((F.coalesce(term, F.lit("")) == "") | text.isNull(), 0).otherwise(F.regexp_count(text, quoted))


def swap_aliases(text: Column, aliases: list[str], substitute: str) -> Column:
    """Whole-word replacement of every alias, the longest first, ignoring case."""
    return swapped_with_count(text, aliases, substitute)["text"]


def swapped_with_count(text: Column, aliases: list[str], substitute: str) -> Column:
    """(text, n): the text with every alias replaced, the longest first, and the number of replacements."""
    said, n = substitute.replace("\\", "\\\\").replace("$", "\\$"), F.lit(0)
    for alias in sorted({a for a in aliases if a}, key=lambda a: (-len(a), a)):
        pattern = rf"(?iU)(?<!\w){_quoted(alias)}(?!\w)"
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, said)
    return F.struct(text.alias("text"), n.alias("n"))


def swapped_by_columns(text: Column, aliases: Column, substitute: Column) -> Column:
    """``swapped_with_count`` where aliases and substitute are columns; a null substitute leaves the text as it is."""
    order = F.array_sort(F.array_distinct(F.filter(aliases, lambda a: F.coalesce(a, F.lit("")) != "")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    said = F.regexp_replace(substitute, r"([\\$])", r"\\$1")
    start = F.struct(text.alias("text"), F.lit(0).alias("n"))
    quoted = lambda a: F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(a, r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(r"(?!\w)"))
    swapped = F.aggregate(order, start, lambda x, a: F.struct(F.regexp_replace(x["text"], quoted(a), said).alias("text"), (x["n"] + F.regexp_count(x["text"], quoted(a))).alias("n")))
    return F.when(substitute.isNull(), start).otherwise(swapped)


def frequency_stratum(count: Column) -> Column:
    found = F.lit("1000+")
    for most, name in reversed(STRATA):
        found = F.when(count <= most, name).otherwise(found)
    return found


def sigmoid_ratio(original: Column, swapped: Column) -> Column:
    """How much of the preference sits with the original, from two log-likelihoods; stable at both ends."""
    x = original - swapped
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def last_number(text: Column) -> Column:
    """The last number of a text whose commas are dropped; the trimmed text if it has none."""
    clean = F.replace(text, F.lit(","), F.lit(""))
    return F.coalesce(F.try_element_at(F.regexp_extract_all(clean, F.lit(r"-?\d+(?:\.\d+)?"), 0), F.lit(-1)), F.trim(clean))


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """The text before the first of the stop strings, white space at its start left out before the search."""
    said = F.regexp_replace(text, r"^\s+", "")
    places = [F.when(F.instr(said, s) > 0, F.instr(said, s) - 1) for s in stops]
    return F.substring(said, F.lit(1), F.least(F.length(said), *places)) if places else said


def log_bin(popularity: Column) -> Column:
    """Decimal bin of a popularity: <2, 2-3, 3-4 or >=4."""
    size = F.log10(F.greatest(popularity, F.lit(1.0)))
    return F.when(size < 2, "<2").when(size < 3, "2-3").when(size < 4, "3-4").otherwise(">=4")


def room_left(context: Column, continuation: Column, budget: int) -> Column:
    """The last tokens of a context that fit a budget beside its continuation, which is never cut; the whole where no room is left."""
    room = budget - F.size(continuation)
    return F.when((room > 0) & (F.size(context) > room), F.slice(context, F.greatest(F.size(context) - room + 1, F.lit(1)), F.greatest(room, F.lit(0)))).otherwise(context)


def has_repeated_ngram(ids: Column, n: int) -> Column:
    grams = F.when(F.size(ids) >= n, F.transform(F.sequence(F.lit(1), F.size(ids) - n + 1), lambda i: F.array_join(F.slice(ids, i, n), "\x1f"))).otherwise(F.array().cast("array<string>"))
    return F.size(grams) != F.size(F.array_distinct(grams))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
