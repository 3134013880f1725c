"""Benchmark decontamination by winnowed k-gram fingerprints, extended to exact windows. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.native import free_name, hint, let, lower_ascii, numbers, text_key
from textloom.storage import stored

#: A window of WINDOW words holds WINDOW - GRAM + 1 grams of GRAM words; the least of these is kept for every window.
WINDOW, GRAM = 10, 5
KEPT = WINDOW - GRAM + 1
#: Fixed value: what stands between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The low bits of a gram's hash hold its position modulo 8, from which a window recovers the position.
LOW = 7


def words(text: Column) -> Column:
    """Lower-cased words of a whole text; null has none."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), GAP), "")


def _gram(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(w[at + i] for i in range(k)))


def winnowed(w: Column) -> Column:
    """(start of window, least gram) wherever the least gram of a window isn't that of the window before; positions count from 0.

    Every run of WINDOW words shared by two texts has all its grams in both, so both keep the same least gram in it.
    """
    n = F.size(w)
    grams = F.transform(numbers(F.lit(0), n - GRAM), lambda i: _gram(w, i, GRAM).bitwiseAND(F.lit(~LOW)).bitwiseOR(F.pmod(i, F.lit(LOW + 1)).cast("long")))
    least = lambda g: F.transform(numbers(F.lit(1), F.size(g) - KEPT + 1), lambda s: F.array_min(F.slice(g, s, KEPT)))
    changes = lambda m: F.filter(
        F.transform(m, lambda x, i: F.struct(i.alias("s"), x.alias("x"), (F.when(i > 0, m[i - 1]).otherwise(F.bitwise_not(x)) != x).alias("new"))), lambda c: c["new"]
    )
    return let(grams, lambda g: let(least(g), changes))


def _marks(w: Column, short: list[int]) -> Column:
    """(len, p, f) of every kept fingerprint: the winnowed ones, and all grams of the lengths of shorter items."""
    long_ones = F.transform(
        winnowed(w), lambda c: F.struct(F.lit(WINDOW).alias("len"), (c["s"] + F.pmod(c["x"].bitwiseAND(F.lit(LOW)).cast("int") - c["s"], F.lit(LOW + 1))).alias("p"), c["x"].bitwiseAND(F.lit(~LOW)).alias("f"))
    )
    parts = [long_ones]
    for k in short:
        every = lambda k: F.transform(numbers(F.lit(0), F.size(w) - k), lambda i: F.struct(F.lit(k).alias("len"), i.alias("p"), _gram(w, i, k).alias("f")))
        parts.append(every(k))
    return F.concat(*parts) if len(parts) > 1 else long_ones


def _joined(w: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, start + 1, n), " ")


def _windows(w: Column) -> Column:
    """(len, window) of an item: every WINDOW words, or all words of a shorter item."""
    starts = numbers(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(F.least(F.size(w), F.lit(WINDOW)).alias("len"), _joined(w, i, F.lit(WINDOW)).alias("window")))


def _matches(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(t1, t2, n_hit, hit_items) of every text that holds a window of an item, by the 128-bit key of the text."""
    bench = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    windows = bench.select("item", F.explode(let(F.col("w"), _windows)).alias("x"))
    windows = stored(windows.select("x.len", "x.window", "item").distinct(), "windows")
    short = sorted(r.len for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect())  # nine lengths at most
    marks = bench.select(F.explode(let(F.col("w"), lambda w: _marks(w, short))).alias("m")).select("m.len", "m.f").distinct()
    marks = stored(marks, "item-marks")

    base = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = base.select(*text_key(F.col("text")), F.explode(let(words(F.col("text")), lambda w: _marks(w, short))).alias("m"))
    found = found.select("t1", "t2", F.col("m.len").alias("len"), F.col("m.p").alias("p"), F.col("m.f").alias("f"))
    anchors = found.join(hint(marks), ["len", "f"], "left_semi").select("t1", "t2", "len", "p").distinct()
    # grouped by text: at most as many anchors as it has words
    anchors = stored(anchors.groupBy("t1", "t2").agg(F.collect_list(F.struct("len", "p")).alias("anchors")), "anchors")

    keyed = base.withColumns(dict(zip(("t1", "t2"), text_key(F.col("text")), strict=True)))
    near = keyed.join(hint(anchors.select("t1", "t2")), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).join(anchors, ["t1", "t2"])
    reach = lambda a, n: F.when(a["len"] == WINDOW, F.transform(numbers(F.greatest(a["p"] - (KEPT - 1), F.lit(0)), F.least(a["p"], n - WINDOW)), lambda s: F.struct(F.lit(WINDOW).alias("len"), s.alias("s")))).otherwise(F.array(F.struct(a["len"].alias("len"), a["p"].alias("s"))))
    extended = let(words(F.col("text")), lambda w: F.transform(F.array_distinct(F.flatten(F.transform("anchors", lambda a: reach(a, F.size(w))))), lambda x: F.struct(x["len"].alias("len"), x["s"].alias("s"), _joined(w, x["s"], x["len"]).alias("window"))))
    tried = near.select("t1", "t2", F.explode(extended).alias("x")).select("t1", "t2", "x.len", "x.s", "x.window")
    texts = windows.select("len", "window").distinct()
    hits = stored(tried.join(hint(stored(texts, "window-texts")), ["len", "window"]).select("t1", "t2", "len", "s", "window"), "hits")

    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("s", "len"))), F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["reach"], x["s"] + x["len"]).alias("reach"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(x["s"], a["reach"]))).alias("n")),
        lambda a: a["n"],
    )
    n_hit = hits.groupBy("t1", "t2").agg(covered.alias("n_hit"))
    of_item = hits.select("t1", "t2", "len", "window").distinct().join(windows, ["len", "window"]).select("t1", "t2", "item").distinct()
    named = of_item.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    return stored(n_hit.join(named, ["t1", "t2"], "left"), "matches")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    A window is any 10 consecutive words of an item, or all words of a shorter one. Texts and items that are null or have no word hit
    nothing; repeated rows get the same result each; an item that repeats counts once by its id, and one without an id counts for hits
    only; an empty table on either side hits nothing. Other columns are never read. What a text matches depends on the text alone, so
    copies are matched once: anchors meet by a 128-bit key of the text, and no pair of documents is ever formed. A side is broadcast only
    when its bytes are measured to be few; beyond that, what the texts matched is a table that a hot text's rows are dealt out to.
    """
    result = _matches(docs, items, text_col, item_col, item_text_col)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text), F.size(words(text)).cast("long").alias("n_words")).join(hint(result), ["t1", "t2"], "left")
    of = F.coalesce("hit_items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(of).cast("long").alias("n_items"), F.sha2(F.array_join(of, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of an item; null texts and null ids are rows like any other."""
    found = _matches(docs, items, text_col, item_col, item_text_col).select("t1", "t2")
    t1, t2 = free_name(docs, "t1"), free_name(docs, "t2")
    keyed = docs.withColumns(dict(zip((t1, t2), text_key(F.col(f"`{text_col}`").cast("string")), strict=True)))
    return keyed.join(hint(found.withColumnsRenamed({"t1": t1, "t2": t2})), [t1, t2], "left_anti").drop(t1, t2)
