"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

The fingerprint of a table is a hash of its sorted nested field paths.  It
selects a mapping, which says with expressions where the turns are: rows of a
turn each, a list of messages, or prompt and answer fields.  All layouts end in
the same ``array<struct<role, text>>``, and one template writes it.

The template marks turns with ``<|start|>``, ``<|text|>`` and ``<|end|>``.  In
roles and texts a backslash becomes ``\\e``, ``<`` becomes ``\\l`` and ``[``
becomes ``\\b``, so no control string of this or a bracketed template can stand
there.  Each backslash of an escaped string begins a pair, hence undoing the
pairs with the backslash last gives back the text.

Defined results: a null text or role counts as empty; rows of one conversation
go by turn, then role, then text, nulls first; rows without a conversation id
are one conversation in a layout of rows and one each in the others; ids may be
numbers or text; repeated rows are turns of their own; an empty table gives no
conversations; fields that no mapping names are ignored.  A conversation is one
value, so its turns meet in one task; they are bounded by what a row of the
output may hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Every leaf of a schema as a path; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _str(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _turn(role: str, c: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), c.alias("text"))


def _messages(column: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[], Column]:
    def make() -> Column:
        def one(m: Column) -> Column:
            r = _str(m[role])
            for old, new in (names or {}).items():
                r = F.when(r == old, F.lit(new)).otherwise(r)
            return F.struct(r.alias("role"), _str(m[text]).alias("text"))

        return F.transform(F.coalesce(F.col(column), F.array().cast(f"array<struct<{role}:string,{text}:string>>")), one)

    return make


def _pair(prompt: str, answer: str) -> Callable[[], Column]:
    return lambda: F.array(_turn("user", _str(prompt)), _turn("assistant", _str(answer)))


def _instruction() -> Column:
    extra = _str("input")
    asked = F.when(extra == "", _str("instruction")).otherwise(F.concat(_str("instruction"), F.lit("\n"), extra))
    return F.array(_turn("user", asked), _turn("assistant", _str("output")))


#: Paths a mapping needs -> the expression for its turns.
MAPPINGS: dict[tuple[str, ...], Callable[[], Column]] = {
    ("messages[].content", "messages[].role"): _messages("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ("input", "instruction", "output"): _instruction,
    ("instruction", "output"): _pair("instruction", "output"),
    ("prompt", "response"): _pair("prompt", "response"),
    ("prompt", "completion"): _pair("prompt", "completion"),
    ("answer", "question"): _pair("question", "answer"),
}
ROWS = ("conv_id", "role", "text", "turn")
_KNOWN = {fingerprint(list(k)): v for k, v in MAPPINGS.items()}


def mapping_for(schema: T.StructType) -> Callable[[], Column] | str | None:
    """The mapping whose fingerprint is that of the schema or, with extra fields, of the most of its paths."""
    paths = field_paths(schema)
    if fingerprint(paths) == fingerprint(list(ROWS)):
        return "rows"
    if exact := _KNOWN.get(fingerprint(paths)):
        return exact
    inside = [k for k in [ROWS, *MAPPINGS] if set(k) <= set(paths)]
    if not inside:
        return None
    best = max(inside, key=lambda k: (len(k), k))
    return "rows" if best == ROWS else _KNOWN[fingerprint(list(best))]


def _ident(df: DataFrame, key: str) -> Column:
    """The id as it is: a whole number as long, anything else as text."""
    kind = df.schema[key].dataType
    return F.col(key).cast("long" if isinstance(kind, T.IntegralType) else "string")


def canonical(df: DataFrame) -> DataFrame:
    """conv_id, turns: one row a conversation, whatever the layout of ``df``."""
    how = mapping_for(df.schema)
    if how is None:
        raise ValueError(f"no mapping for the fields {field_paths(df.schema)}")
    if how == "rows":
        one = F.struct(F.col("turn").cast("long").alias("turn"), _str("role").alias("role"), _str("text").alias("text"))
        rows = df.select(_ident(df, "conv_id").alias("conv_id"), one.alias("t"))
        turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return rows.groupBy("conv_id").agg(turns.alias("turns"))
    key = next((c for c in ("conv_id", "id") if c in df.columns), None)
    ident = _ident(df, key) if key else F.monotonically_increasing_id()
    return df.select(ident.alias("conv_id"), how().cast(TURNS).alias("turns"))


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(convs: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the text and the spans (code points, end exclusive) under the loss mask."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def walk(a: Column, p: Column) -> Column:
        start = (a["at"] + F.length(p["head"])).cast("long")
        end = (start + F.length(p["body"])).cast("long")
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(p["role"] == trained, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    df = convs.select("conv_id", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return df.select("conv_id", text.alias("formatted"), F.aggregate("parts", zero, walk)["out"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns, read back from a formatted text."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(p: Column) -> Column:
        halves = F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|text\|>", -1)
        return F.struct(unescape(F.element_at(halves, 1)).alias("role"), unescape(F.element_at(halves, 2)).alias("text"))

    return F.transform(body, one)


def digest(rendered: DataFrame) -> DataFrame:
    """The columns that show, from the output alone, what was kept and what is trained on."""
    turns = parse(F.col("formatted"))
    df = rendered.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))
    spelt = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    df = df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelt, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return df.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
