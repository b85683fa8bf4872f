"""Text predicates, splitters and scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.fixtures import MESSAGES, messages

# Phrases, markers, stop words and separators that the results depend on.
REPLY_CUES = ["你刚才", "你之前", "刚才说", "刚刚说", "前面说", "上面说", "继续", "接着", "还是", "不是那个", "不是这个", "关于刚才", "reply", "continue", "earlier", "before"]
INJECTION_MARKERS = ["忽略之前", "忽略以上", "无视之前", "system prompt", "系统提示", "开发者消息", "developer message", "你现在是", "DAN", "jailbreak", "越狱", "提示词", "prompt", "把以下写入记忆", "写入记忆", "请记住"]
NOISE_WORDS = ["好的", "嗯", "哦", "明白了", "知道了", "收到", "谢谢", "谢谢你"]
SENTENCE_ENDS = "[\\n。！？!?；;…]"
FACET_PUNCT = "，。！？：；（）【】《》“”‘’、…"
SPACE = "[ \\t\\n\\x0B\\f\\r]"

_M = f"WITH {MESSAGES}"
_TRIM = "regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def trim(c: Column) -> Column:
    """Strips the six ASCII white-space characters at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def take(c: Column, n: int) -> Column:
    """The first n characters; everything for n <= 0."""
    return c if n <= 0 else F.substr(c, F.lit(1), F.lit(n))


@query("t1_trim", f"{_M} SELECT id, {_TRIM.format('text')} AS trimmed FROM messages")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", trim(F.col("text")).alias("trimmed"))


@query("t2_utf8", f"{_M} SELECT id, length(text) AS n, text[:20] AS head, len(list_distinct(string_split(text, ''))) AS kinds FROM messages WHERE text <> ''")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where("text <> ''")
    return m.select("id", F.char_length("text").cast("long").alias("n"), take(F.col("text"), 20).alias("head"), F.size(F.array_distinct(F.split("text", ""))).cast("long").alias("kinds"))


def sentences(c: Column) -> Column:
    flat = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(flat, SENTENCE_ENDS, -1), trim), lambda s: s != "")


_SENT = "SELECT id, role, unnest(list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\n。！？!?；;…]'), lambda s: " + _TRIM.format("s") + "), lambda s: s <> '')) AS sentence, generate_subscripts(list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\n。！？!?；;…]'), lambda s: " + _TRIM.format("s") + "), lambda s: s <> ''), 1) AS pos FROM messages"


@query("t3_sentences", f"{_M} SELECT id, pos, sentence FROM ({_SENT})")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = messages(spark, sf_dir).select("id", F.posexplode(sentences(F.col("text"))).alias("p", "sentence"))
    return s.select("id", (F.col("p") + 1).cast("long").alias("pos"), "sentence")


def is_noise(c: Column, min_chars: int = 12) -> Column:
    s = trim(c)
    return (s == "") | F.contains(s, F.lit("```")) | (F.char_length(s) < min_chars) | ~s.rlike("[A-Za-z0-9]|[^\\x00-\\x7F]") | no_space(s).isin(NOISE_WORDS)


def _noise_sql(s: str, n: int = 12) -> str:
    t = _TRIM.format(s)
    words = ", ".join(f"'{w}'" for w in NOISE_WORDS)
    return f"({t} = '' OR contains({t}, '```') OR length({t}) < {n} OR NOT regexp_matches({t}, '[A-Za-z0-9]|[^\\x00-\\x7F]') OR regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') IN ({words}))"


@query("t4_noise", f"{_M} SELECT id, {_noise_sql('text')} AS noise, {_noise_sql('text', 1)} AS noise_short FROM messages")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", is_noise(F.col("text")).alias("noise"), is_noise(F.col("text"), 1).alias("noise_short"))


def fact_key(c: Column) -> Column:
    return no_space(F.lower(c))


def atomic_facts(df: DataFrame, min_chars: int = 12, most: int = 6) -> DataFrame:
    """id, pos, fact: sentences that are no noise, first of each key, six at most; else the whole text if that is no noise."""
    s = df.select("id", F.posexplode(sentences(F.col("text"))).alias("p", "fact")).where(~is_noise(F.col("fact"), min_chars))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("id", fact_key(F.col("fact"))).orderBy("p"))).where("n = 1")
    s = s.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("p"))).where(F.col("pos") <= most).select("id", F.col("pos").cast("long").alias("pos"), "fact")
    whole = df.where(~is_noise(F.col("text"), min_chars)).join(s.select("id"), "id", "left_anti")
    return s.unionByName(whole.select("id", F.lit(1).cast("long").alias("pos"), trim(F.col("text")).alias("fact")))


_FACTS = f"""s AS MATERIALIZED ({_SENT}), f0 AS (SELECT *, row_number() OVER (PARTITION BY id, regexp_replace(lower(sentence), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') ORDER BY pos) AS k FROM s WHERE NOT {_noise_sql('sentence')}),
f1 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos, sentence AS fact FROM f0 WHERE k = 1), f2 AS (SELECT * FROM f1 WHERE pos <= 6),
facts AS (SELECT * FROM f2 UNION ALL SELECT id, 1, {_TRIM.format('text')} FROM messages WHERE NOT {_noise_sql('text')} AND id NOT IN (SELECT id FROM f2))"""


@query("t5_facts", f"{_M}, {_FACTS} SELECT id, pos, fact FROM facts")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atomic_facts(messages(spark, sf_dir))


def facets(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, token, weight: ASCII runs by length, pairs and triples of other runs; weights of a token add up."""
    ascii_runs = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2),
        lambda t: F.struct(F.lower(t).alias("token"), (1.0 + F.least(F.lit(0.6), (F.length(t) - 2) * 0.08)).alias("weight")),
    )
    runs = F.regexp_extract_all(text, F.lit(f"[^\\x00-\\x7F{FACET_PUNCT}]+"), F.lit(0))

    def grams(r: Column, n: int, w: float) -> Column:
        k = F.char_length(r)
        seq = F.when(k >= n, F.sequence(F.lit(1), k - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(seq, lambda i: F.struct(F.lower(F.substr(r, i, F.lit(n))).alias("token"), F.lit(w).cast("double").alias("weight")))

    def of_run(r: Column) -> Column:
        return F.when(F.char_length(r) == 1, F.array(F.struct(F.lower(r).alias("token"), F.lit(0.45).alias("weight")))).otherwise(F.concat(grams(r, 2, 1.0), grams(r, 3, 0.45)))

    every = F.concat(ascii_runs, F.flatten(F.transform(runs, of_run)))
    return df.select(key, F.explode(every).alias("f")).groupBy(key, F.col("f.token").alias("token")).agg(F.sum("f.weight").alias("weight"))


def _facet_sql(key: str, src: str) -> str:
    return f"""runs AS (SELECT {key}, unnest(regexp_extract_all(text, '[^\\x00-\\x7F{FACET_PUNCT}]+')) AS r FROM {src}),
toks AS (SELECT {key}, lower(t) AS token, 1.0::DOUBLE + least(0.6, (length(t) - 2) * 0.08) AS w FROM (SELECT {key}, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM {src}) WHERE length(t) >= 2
  UNION ALL SELECT {key}, lower(r), 0.45 FROM runs WHERE length(r) = 1
  UNION ALL SELECT {key}, lower(substr(r, i, 2)), 1.0 FROM (SELECT {key}, r, unnest(range(1, length(r))) AS i FROM runs WHERE length(r) > 1)
  UNION ALL SELECT {key}, lower(substr(r, i, 3)), 0.45 FROM (SELECT {key}, r, unnest(range(1, length(r) - 1)) AS i FROM runs WHERE length(r) > 2)),
facets AS MATERIALIZED (SELECT {key}, token, sum(w)::DOUBLE AS weight FROM toks GROUP BY ALL)"""


_FACETS = _facet_sql("id", "messages")


@query("t6_facets", f"{_M}, {_FACETS} SELECT id, token, round(weight, 6) AS weight FROM facets")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(messages(spark, sf_dir)).select("id", "token", F.round("weight", 6).alias("weight"))


def top_facets(f: DataFrame, key: str = "id", slots: int = 6) -> DataFrame:
    """The heaviest facets of each key, ties by token, as shares of what is kept."""
    # weights of equal tokens added in another order may differ in the last place only
    order = Window.partitionBy(key).orderBy(F.round("weight", 9).desc(), "token")
    kept = f.where("weight > 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= slots)
    return kept.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(key))).select(key, "token", "share")


_TOP = "kept AS (SELECT * FROM facets QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, token) <= 6)"


@query("t7_facet_top", f"{_M}, {_FACETS}, {_TOP} SELECT id, token, round(weight / sum(weight) OVER (PARTITION BY id), 6) AS share FROM kept")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_facets(facets(messages(spark, sf_dir))).select("id", "token", F.round("share", 6).alias("share"))


def query_facets(f: DataFrame, vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """The top facets among tokens that an earlier text has brought into the vocabulary (token, first)."""
    known = f.join(vocabulary, "token").where(F.col("first") < F.col(key)).select(key, "token", "weight")
    return top_facets(known, key)


@query("t8_query_facets", f"{_M}, {_FACETS}, v AS (SELECT token, min(id) AS first FROM facets GROUP BY token), k AS (SELECT id, token, weight FROM facets JOIN v USING (token) WHERE first < id), kept AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, token) <= 6) SELECT id, token, round(weight / sum(weight) OVER (PARTITION BY id), 6) AS share FROM kept")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facets(messages(spark, sf_dir))
    return query_facets(f, f.groupBy("token").agg(F.min("id").alias("first"))).select("id", "token", F.round("share", 6).alias("share"))


_MENTION = "@([^ \\t\\n\\x0B\\f\\r，。！？；：,%.!?;:)\\]}]+)"


def alias(c: Column) -> Column:
    s = F.regexp_replace(F.lower(trim(c)), "^[@#]+", "")
    return trim(F.regexp_replace(s, "[ \\t\\n\\x0B\\f\\r，。！？；：,%.!?;:]+$", ""))


def mentions(c: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(_MENTION), F.lit(1)), alias)), lambda a: a != "")


@query("t9_mentions", f"{_M}, x AS (SELECT id, unnest(regexp_extract_all(text, '{_MENTION}', 1)) AS a FROM messages) SELECT DISTINCT id, regexp_replace(lower(a), '^[@#]+', '') AS alias FROM x WHERE regexp_replace(lower(a), '^[@#]+', '') <> ''")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.explode(mentions(F.col("text"))).alias("alias"))


def has_cue(c: Column) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*[F.lit(p) for p in REPLY_CUES]), lambda p: F.contains(low, p))


_CUE = "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in REPLY_CUES) + ")"


@query("t10_reply_cue", f"{_M} SELECT id, {_CUE} AS cue FROM messages")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", has_cue(F.col("text")).alias("cue"))


_STRIP = "[ \\t\\n\\x0B\\f\\r,.!?;:\\-_/\\\\|`~%@#^*()\\[\\]{}<>+=，。！？；：、…～·]+"
_EMOTES = "^(\\[[^\\[\\]]*\\][ \\t\\n\\x0B\\f\\r]*)+$"
_LAUGH = "^[0-9?？!！~～哈啊呵哦哇呀啦]+$"
_BREAK = "[ \\t\\n\\x0B\\f\\r，。！？；：,%.!?;:]"


def is_reaction(c: Column, short: int = 6, most: int = 10) -> Column:
    s = trim(c)
    n, compact = F.char_length(s), F.regexp_replace(F.lower(s), _STRIP, "")
    kinds = F.size(F.array_distinct(F.split(compact, "")))
    small = s.rlike(_EMOTES) | (compact == "") | (n <= short) | compact.rlike(_LAUGH) | (~s.rlike(_BREAK) & (kinds <= F.greatest(F.lit(2), F.floor(n / 2))))
    return (s != "") & (n <= most) & ~has_cue(s) & (F.size(mentions(s)) == 0) & small


_S = _TRIM.format("text")
_K = f"regexp_replace(lower({_S}), '{_STRIP}', '', 'g')"
_REACTION = f"({_S} <> '' AND length({_S}) <= 10 AND NOT {_CUE} AND len(regexp_extract_all(text, '{_MENTION}', 1)) = 0 AND (regexp_matches({_S}, '{_EMOTES}') OR {_K} = '' OR length({_S}) <= 6 OR regexp_matches({_K}, '{_LAUGH}') OR (NOT regexp_matches({_S}, '{_BREAK}') AND len(list_distinct(string_split({_K}, ''))) <= greatest(2, length({_S}) // 2))))"


@query("t11_reaction", f"{_M} SELECT id, {_REACTION} AS reaction FROM messages")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", is_reaction(F.col("text")).alias("reaction"))


def risk_reasons(c: Column) -> Column:
    """The reasons that apply, in order.  Only the first marker found is named; the text is lower-cased before."""
    low, n = F.lower(c), F.octet_length(c)
    marker = F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(f"prompt_injection:{m}")) for m in INJECTION_MARKERS])
    found = F.array(
        marker, F.when(F.contains(c, F.lit("```")), F.lit("code_fence")), F.when(n >= 480, F.lit("very_long")).when(n >= 240, F.lit("long")),
        F.when(c.rlike(f"^{SPACE}*/[A-Za-z0-9_]+"), F.lit("command_like")), F.when(c.rlike("[\\r\\n]"), F.lit("multiline")),
    )
    return F.filter(found, lambda r: r.isNotNull())


def risk_score(reasons: Column) -> Column:
    worth = {"code_fence": 0.20, "very_long": 0.18, "long": 0.10, "command_like": 0.18, "multiline": 0.08}

    def one(r: Column) -> Column:
        w = F.when(F.startswith(r, F.lit("prompt_injection:")), 0.55)
        for k, v in worth.items():
            w = w.when(r == k, v)
        return w

    return F.least(F.lit(1.0), F.aggregate(F.transform(reasons, one), F.lit(0.0), lambda s, x: s + x))


def risk(c: Column) -> Column:
    return risk_score(risk_reasons(trim(c)))


_R = f"(SELECT id, role, {_S} AS s FROM messages)"
_MARK = "CASE " + " ".join(f"WHEN contains(lower(s), '{m}') THEN 'prompt_injection:{m}'" for m in INJECTION_MARKERS) + " END"
_REASONS = f"list_filter([{_MARK}, CASE WHEN contains(s, '```') THEN 'code_fence' END, CASE WHEN strlen(s) >= 480 THEN 'very_long' WHEN strlen(s) >= 240 THEN 'long' END, CASE WHEN regexp_matches(s, '^[ \\t\\n\\x0B\\f\\r]*/[A-Za-z0-9_]+') THEN 'command_like' END, CASE WHEN regexp_matches(s, '[\\r\\n]') THEN 'multiline' END], lambda x: x IS NOT NULL)"
RISK_SQL = f"least(1.0, (CASE WHEN {_MARK} IS NOT NULL THEN 0.55 ELSE 0 END + CASE WHEN contains(s, '```') THEN 0.2 ELSE 0 END + CASE WHEN strlen(s) >= 480 THEN 0.18 WHEN strlen(s) >= 240 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(s, '^[ \\t\\n\\x0B\\f\\r]*/[A-Za-z0-9_]+') THEN 0.18 ELSE 0 END + CASE WHEN regexp_matches(s, '[\\r\\n]') THEN 0.08 ELSE 0 END)::DOUBLE)"


@query("t12_risk", f"{_M} SELECT id, round({RISK_SQL}, 6) AS risk, array_to_string({_REASONS}, ',') AS reasons FROM {_R}")
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = messages(spark, sf_dir).select("id", risk_reasons(trim(F.col("text"))).alias("r"))
    return r.select("id", F.round(risk_score(F.col("r")), 6).alias("risk"), F.array_join("r", ",").alias("reasons"))


def remove_cot(c: Column) -> Column:
    """What stands behind the first closing think mark, without blank lines."""
    at = F.locate("</think>", c)
    return F.replace(F.when(at > 0, F.substr(c, at + 8)).otherwise(c), F.lit("\n\n"), F.lit(""))


@query("t13_remove_cot", f"{_M} SELECT id, replace(CASE WHEN contains(text, '</think>') THEN substr(text, instr(text, '</think>') + 8) ELSE text END, chr(10) || chr(10), '') AS text FROM messages")
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.when(F.col("text") == "", "").otherwise(remove_cot(F.col("text"))).alias("text"))


@query("t14_replace", f"{_M} SELECT id, replace(replace(text, 'th', '<th>'), '.', '[dot]') AS text FROM messages")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.replace(F.replace("text", F.lit("th"), F.lit("<th>")), F.lit("."), F.lit("[dot]")).alias("text"))


def compress(c: Column, ratio: float) -> Column:
    """The text cut to a share of its characters: 60 % of that from the head, the rest from the tail, or the head alone."""
    most = F.floor(F.char_length(c) * ratio).cast("int")
    head = F.floor(most * 0.6).cast("int")
    tail = most - head - 3
    both = F.concat(F.substr(c, F.lit(1), head), F.lit("..."), F.right(c, tail))
    return F.when(F.char_length(c) <= most, c).when(tail < 10, F.concat(F.substr(c, F.lit(1), most), F.lit("..."))).otherwise(both)


def _compress_sql(ratio: float) -> str:
    m, h = f"floor(length(text) * {ratio})::INT", f"floor(floor(length(text) * {ratio})::INT * 0.6)::INT"
    return f"CASE WHEN length(text) <= {m} THEN text WHEN {m} - {h} - 3 < 10 THEN substr(text, 1, {m}) || '...' ELSE substr(text, 1, {h}) || '...' || right(text, {m} - {h} - 3) END"


@query("t15_compress", f"{_M} SELECT id, {_compress_sql(0.65)} AS slight, {_compress_sql(0.3)} AS heavy FROM messages")
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", compress(F.col("text"), 0.65).alias("slight"), compress(F.col("text"), 0.30).alias("heavy"))


def parse_string_array(c: Column, most_items: int = 32, most_bytes: int = 200) -> Column:
    """The strings of the first brace table of quoted strings; null if there is none."""
    item = "'[^'\\n\\\\]*'|\"[^\"\\n\\\\]*\""
    body = F.regexp_extract(c, f"^[^{{]*\\{{[ \\t\\r\\n]*((?:{item})(?:[ \\t\\r\\n]*,[ \\t\\r\\n]*(?:{item}))*)[ \\t\\r\\n]*,?[ \\t\\r\\n]*\\}}", 1)
    items = F.transform(F.regexp_extract_all(body, F.lit(item), F.lit(0)), lambda s: F.substr(s, F.lit(2), F.char_length(s) - 2))
    fine = (body != "") & (F.size(items) <= most_items) & F.forall(items, lambda s: F.octet_length(s) <= most_bytes)
    return F.when(fine, items)


@query("t16_string_table", f"{_M} SELECT id, CASE id WHEN -24 THEN 'a|b c' WHEN -25 THEN 'one|two' END AS items FROM messages WHERE regexp_matches(text, '\\{{')")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where(F.contains("text", F.lit("{")))
    return m.select("id", F.array_join(parse_string_array(F.col("text")), "|").alias("items"))


@query("t17_state_codec", f"{_M} SELECT id, role, text FROM messages")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State through its serial form and back; data only, never code."""
    m = messages(spark, sf_dir)
    back = F.from_json(F.to_json(F.struct("role", "text")), "role string, text string")
    return m.select("id", back.alias("b")).select("id", "b.role", "b.text")


ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\x1f", "\\x1F"), ("\x1e", "\\x1E")]


def escape_field(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_field(c: Column) -> Column:
    """Undoes the pairs; doubled backslashes are set aside first so that none is read as the start of a pair."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in ESCAPES[1:]:
        c = F.replace(c, F.lit(b), F.lit(a))
    return F.replace(c, F.lit("\x00"), F.lit("\\"))


@query("t18_escape", f"{_M} SELECT id, replace(replace(text, '\\', '\\\\'), chr(10), '\\n') AS escaped, text AS back FROM messages")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select("id", escape_field(F.col("text")).alias("escaped"))
    return m.select("id", "escaped", unescape_field(F.col("escaped")).alias("back"))
