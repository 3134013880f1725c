"""Chat formatting: records of many layouts become canonical turns, then one marked text with a loss mask. Built-in functions only.

The nested field paths of a record, or of a table of turns, are hashed; the first layout whose path hashes are all among them gives the
declarative mapping. In the
formatted text every turn is ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts get a backslash after their first
character (one more than they have), so a marker can't be forged and reading back removes exactly what was added.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.llm.native import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string: that of our markers, and of other common templates.
_REST = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
_ESCAPE = rf"([<\[])(\\*)(?={_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_REST})"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths`` select it; ``many`` is (container, role field, text field), or ``pairs`` list (role, fields joined by a blank line)."""

    name: str
    paths: tuple[str, ...]
    many: tuple[str, str, str] | None = None
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), many=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), many=("conversations", "from", "value"), roles=_NAMES),
    Layout("instruction_input", ("instruction", "input", "output"), pairs=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), pairs=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_response", ("prompt", "response"), pairs=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), pairs=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), pairs=(("user", ("question",)), ("assistant", ("answer",)))),
)


@dataclass(frozen=True)
class RowLayout:
    """A table of turns: its columns for conversation, turn, role and text, whose paths select it, and other names of roles."""

    name: str
    paths: tuple[str, str, str, str]
    roles: dict[str, str] = field(default_factory=dict)


#: Where the column is named role its values are canonical already and stay as they are.
ROW_LAYOUTS = (
    RowLayout("turn_rows", ("conv_id", "turn", "role", "text")),
    RowLayout("message_rows", ("conversation_id", "message_index", "role", "content")),
    RowLayout("speaker_rows", ("conversation_id", "position", "from", "value"), _NAMES),
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def _paths(record: Column) -> Column:
    """(path, text) of all nested fields of a JSON record, over all elements of its arrays; text says whether only strings stand there.

    They are read from the record's merged schema, as ``OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>``: a walk over its
    names and brackets with the open prefixes as a stack.
    """
    parts = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(record)), F.lit(r"((?:`(?:[^`]|``)*`|[^`<>,: ]+):|OBJECT<|ARRAY<|>|STRING)"), F.lit(1))
    none = F.array().cast("array<struct<path:string,text:boolean>>")
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("now"), none.alias("found"))

    def step(a: Column, t: Column) -> Column:
        top, is_name = F.element_at(a["open"], -1), F.endswith(t, F.lit(":"))
        named = F.concat(top, F.regexp_replace(t, "^`|`?:$", ""))
        array = F.concat(a["now"], F.lit("[]"))
        inner = F.when(a["now"] == "", F.lit("")).otherwise(F.concat(a["now"], F.lit(".")))
        last = F.element_at(a["found"], -1)
        string = (t == "STRING") & (a["now"] != "")
        return F.struct(
            F.when(t == "OBJECT<", F.array_append(a["open"], inner)).when(t == "ARRAY<", F.array_append(a["open"], top)).when((t == ">") & (F.size(a["open"]) > 1), F.slice(a["open"], 1, F.greatest(F.size(a["open"]) - 1, F.lit(1)))).otherwise(a["open"]).alias("open"),
            F.when(is_name, named).when(t == "ARRAY<", array).otherwise(a["now"]).alias("now"),
            F.when(is_name, F.array_append(a["found"], F.struct(named.alias("path"), F.lit(False).alias("text"))))
            .when(string, F.array_append(F.slice(a["found"], 1, F.greatest(F.size(a["found"]) - 1, F.lit(0))), F.struct(last["path"].alias("path"), F.lit(True).alias("text"))))
            .otherwise(a["found"])
            .alias("found"),
        )

    return F.coalesce(F.aggregate(parts, start, step, lambda a: a["found"]), none)


def path_hashes(paths: Column) -> Column:
    """Hashes of field paths; they are the fingerprint that layouts are selected by."""
    return F.transform(paths, lambda p: F.xxhash64(p["path"]))


def layout_of(paths: Column) -> Column:
    """Name of the first layout whose paths are all in a record's fingerprint, null if no mapping is declared for it."""
    chosen = lambda h: F.coalesce(*(F.when(_all_in(x, h), F.lit(x.name)) for x in LAYOUTS))
    return let(path_hashes(paths), chosen)


def _all_in(layout: Layout, hashes: Column) -> Column:
    found = F.lit(True)
    for path in layout.paths:
        found = found & F.array_contains(hashes, F.xxhash64(F.lit(path)))
    return found


def _mapped(layout: Layout, record: Column) -> Column:
    if layout.many:
        container, role, text = layout.many
        parsed = F.from_json(record, f"struct<`{container}`:array<struct<`{role}`:string,`{text}`:string>>>")[container]
        names = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None
        said = lambda m: F.coalesce(F.try_element_at(names, F.coalesce(m[role], F.lit(""))), m[role]) if layout.roles else m[role]
        return F.transform(parsed, lambda m: F.struct(said(m).alias("role"), m[text].alias("text")))
    fields = sorted({f for _, fs in layout.pairs for f in fs})
    parsed = F.from_json(record, "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">")
    full = lambda fs: F.array_join(F.filter(F.array(*(parsed[f] for f in fs)), lambda x: x != ""), "\n\n") if len(fs) > 1 else F.coalesce(parsed[fs[0]], F.lit(""))
    return F.array(*(F.struct(F.lit(role).alias("role"), full(fs).alias("text")) for role, fs in layout.pairs))


def canonical_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, layout, turns, unmapped) of JSON records; unmapped are the paths of strings that the layout leaves out, in order.

    A record that is null, broken or of no declared layout has null layout and no turns (all its strings are unmapped). A turn without one
    of its fields has it empty; a record that repeats is a conversation each time; other columns are never read.
    """
    base = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string").alias("record")).withColumn("paths", _paths(F.col("record")))
    base = base.withColumn("layout", layout_of(F.col("paths")))
    turns = F.lit(None).cast(_TURNS)
    used = F.array().cast("array<string>")
    for x in LAYOUTS:
        turns = F.when(F.col("layout") == x.name, _mapped(x, F.col("record")).cast(_TURNS)).otherwise(turns)
        used = F.when(F.col("layout") == x.name, F.array(*map(F.lit, x.paths))).otherwise(used)
    clean = F.transform(F.coalesce(turns, F.array().cast(_TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    strings = F.transform(F.filter("paths", lambda p: p["text"]), lambda p: p["path"])
    return base.select("conv_id", "layout", clean.alias("turns"), F.array_sort(F.array_except(strings, used)).alias("unmapped"))


def schema_paths(schema: T.StructType, above: str = "") -> list[tuple[str, bool]]:
    """(path, whether it holds strings) of all nested fields of a table."""
    found = []
    for f in schema.fields:
        path, kind = above + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        found.append((path, isinstance(kind, T.StringType)))
        found += schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else []
    return found


def row_layout(schema: T.StructType) -> RowLayout | None:
    """The first row layout whose path hashes are all in the fingerprint of a table's schema."""
    hashes = {xxhash.xxh64_intdigest(p.encode(), 42) for p, _ in schema_paths(schema)}
    return next((x for x in ROW_LAYOUTS if all(xxhash.xxh64_intdigest(p.encode(), 42) in hashes for p in x.paths)), None)


def canonical_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, turns, unmapped) of a table with a row for each turn, in the order of turn, then role, then text.

    The fingerprint of the table's schema selects the row layout, which names the columns and the roles that are said otherwise there; a
    table of no declared layout gives no rows. Null roles and texts count as empty; repeated rows are turns of their own; all rows of a
    null id are one conversation without an id. A conversation is one output row by contract, so its turns must fit a row. unmapped are
    the string columns that the layout leaves out; an empty table gives an empty one.
    """
    layout = row_layout(rows.schema)
    empty = "conv_id long, layout string, " + f"turns {_TURNS}, unmapped array<string>"
    if layout is None:
        return rows.sparkSession.createDataFrame([], empty)
    conv, turn, role, text = layout.paths
    said = F.coalesce(F.col(role).cast("string"), F.lit(""))
    if layout.roles:
        said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]), said), said)
    clean = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), said.alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    turns = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    left = sorted(p for p, string in schema_paths(rows.schema) if string and p not in layout.paths)
    return clean.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.lit(layout.name).alias("layout"), "turns", F.array(*map(F.lit, left)).cast("array<string>").alias("unmapped"))


def formatted(conversations: DataFrame, supervised: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the marked text, and for each supervised turn (turn, start, end), offsets within that turn's block.

    Conversations without turns have an empty text; repeated rows, null ids and very long texts are rows like any other.
    """
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    blocks = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END)))
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == supervised, F.struct(i.alias("turn"), F.length(head(t)).alias("start"), (F.length(head(t)) + F.length(escape(t["text"]))).alias("end"))))
    return conversations.select("conv_id", F.array_join(blocks, "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) parsed from a formatted text and its mask alone; an empty text has no turns."""
    blocks = F.split("formatted", r"<\|end\|>")
    whole = F.slice(blocks, 1, F.size(blocks) - 1)
    part = lambda b, i: unescape(F.split(F.substr(b, F.lit(len(TURN) + 1)), r"<\|text\|>", 2)[i])
    turns = F.transform(whole, lambda b: F.struct(part(b, 0).alias("role"), part(b, 1).alias("text")))
    lost = let(whole, lambda w: F.array_join(F.transform("loss", lambda s: unescape(F.substr(w[s["turn"]], s["start"] + 1, s["end"] - s["start"]))), ""))
    return output.select("conv_id", turns.alias("turns"), lost.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(output: DataFrame) -> DataFrame:
    """Counts and digests of what is read back, a row for each row; without turns they are zero and those of the empty string."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read_back(output).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), "formatted_chars"
    )
