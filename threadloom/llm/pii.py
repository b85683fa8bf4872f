"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All of it is SQL expressions.  Positions come from splitting the text at the
matches: the pieces and the matches alternate, so their lengths give every
offset in code points.  Repetitions are possessive where nothing can be given
back, which keeps the matcher iterative and linear on very long runs; a look
behind keeps it from starting anew inside a run it has already failed on.

Defined results: a null text counts as empty and has no spans; spans of one
kind never overlap, spans of two kinds may; repeated rows and ties are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> pattern, in the order in which spans are listed
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind to be looked for at all.
_GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}
#: Words whose presence before a span makes its kind more likely.
CONTEXT = {
    "email": "mail|contact|write|adresse|correo",
    "ip": "address|server|host|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|anruf",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
#: Score before context; a checksum has confirmed cards and account numbers by then.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_CHARS, CONTEXT_GAIN, LEAST_SCORE = 40, 0.2, 0.5
_SPAN = "array<struct<kind:string,start:long,end:long,text:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the mod-10 check."""
    ds = F.reverse(F.split(_digits(s), ""))

    def worth(d: Column, i: Column) -> Column:
        x = d.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(ds, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an account number leaves 1 when, turned round and spelt in digits, it is divided by 97."""
    c = F.replace(s, F.lit(" "))
    turned = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))

    def step(a: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v < 58, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "))).between(15, 34) & mod97(m)
    return F.lit(True)


def _proposed(text: Column, kind: str) -> Column:
    pattern = PATTERNS[kind]
    alternating = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def walk(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("text"))
        return F.when(x["hit"].isNull(), a).otherwise(F.struct(end.cast("long").alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    found = F.aggregate(alternating, zero, walk)["out"]
    return F.when(_GATES[kind](text), F.filter(found, lambda s: _valid(kind, s["text"]))).otherwise(F.array().cast(_SPAN))


def _scored(text: Column, spans: Column, kind: str) -> Column:
    def score(s: Column) -> Column:
        begin = F.greatest(F.lit(0).cast("long"), s["start"] - CONTEXT_CHARS)
        near = F.substr(text, (begin + 1).cast("int"), (s["start"] - begin).cast("int"))
        gain = F.when(F.lower(near).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), (F.lit(PRIOR[kind]) + gain).alias("score"))

    out = F.transform(spans, score)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, text, and one array of scored spans for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in keep if c not in ("doc_id", "text")], text.alias("text"))
    df = df.select("*", *[_proposed(F.col("text"), k).alias(f"_{k}") for k in PATTERNS])
    kept = [c for c in df.columns if c not in {f"_{k}" for k in PATTERNS}]
    return df.select(*kept, *[_scored(F.col("text"), F.col(f"_{k}"), k).alias(f"pii_{k}") for k in PATTERNS])


def spell(spans: Column) -> Column:
    """kind:start:end for each span, joined by commas; empty for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The counts, the base spans' hash and all spans of each document."""
    found = find(docs).drop("text")
    base = F.concat(*[F.col(f"pii_{k}") for k in BASE])
    every = F.concat(*[F.col(f"pii_{k}") for k in PATTERNS])
    return found.select(
        "doc_id", *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(spell(base), 256).alias("base_sha256"), spell(every).alias("spans"),
        F.array_max(F.transform(every, lambda s: s["score"])).alias("top_score"),
    )


def redact(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents, each span replaced by its kind in angle brackets; rows and columns stay as they are."""
    # the other columns travel as one, so that none of their names can meet one of ours
    other = [c for c in columns if c != "text"]
    whole = docs.select(F.struct(*other).alias("row"), F.lit(None).cast("long").alias("doc_id"), "text", F.col("text").isNull().alias("pii_null"))
    found = find(whole, ("row", "pii_null"))
    # spans of two kinds may overlap: the first one wins, by start and then by length
    every = F.array_sort(F.transform(F.concat(*[F.col(f"pii_{k}") for k in PATTERNS]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("till"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def walk(a: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        new = F.struct((-s["till"]).cast("long").alias("at"), F.concat(a["out"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"))
        return F.when(s["start"] < a["at"], a).otherwise(new)

    cut = F.aggregate(F.col("pii_all"), zero, walk)
    df = found.select("row", "text", "pii_null", every.alias("pii_all"))
    df = df.select("row", "text", "pii_null", cut.alias("pii_cut"))
    rest = F.concat(F.array_join("pii_cut.out", ""), F.substr(F.col("text"), (F.col("pii_cut.at") + 1).cast("int")))
    text = F.when(F.col("pii_null"), None).when(F.size("pii_cut.out") == 0, F.col("text")).otherwise(rest)
    return df.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])
