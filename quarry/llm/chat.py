"""Chat formatting of typed content parts.

A visitor over a turn's parts flattens text, image, audio and document parts into one string: texts
escaped, neighbouring ones as one, attachments as ordered placeholders <|image:1|>, with the
attachment's reference and the tokens that the placeholder expands to kept beside it. Turns stand
between control strings; every control string inside a text or role is escaped, and unescaping gives
the text back.

Escape: a backslash is doubled, then a backslash goes after the first character of every control string.
Defined results: a null text or role is empty; a null or unknown kind of part counts as text; a turn
without parts is empty; turns sort by number (null first), then role and text; repeated rows are turns of
their own. A conversation becomes one row, so it must fit into a row; turns of a null conv_id are one
conversation, in order like any other's, and that too must fit; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this template and of other common ones.
CONTROL = r"<\|[A-Za-z0-9_:]*\|>|</?s>|\[/?INST\]|<</?SYS>>"
#: Tokens that an attachment expands to where the part does not say.
EXPANSION = {"image": 576, "audio": 750, "document": 1024}


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(parts: Column) -> Column:
    """struct(body, attachments) of array<struct<kind, text, ref, tokens>>: placeholders number each kind in order.

    One walk over the parts: the texts since the last attachment are held as one run and escaped together, so
    that no control string can be put together from the ends of neighbouring parts.
    """
    kind = lambda p: F.when(p["kind"].isin(list(EXPANSION)), p["kind"]).otherwise(F.lit("text"))
    default = F.create_map(*[F.lit(x) for pair in EXPANSION.items() for x in pair])
    zero = F.lit(0).cast("long")
    listed = "array<struct<kind:string,placeholder:string,ref:string,tokens:bigint>>"
    texts = "array<string>"
    start = F.struct(F.array().cast(texts).alias("done"), F.array().cast(texts).alias("run"), F.array().cast(listed).alias("attachments"), *[zero.alias(k) for k in EXPANSION])

    def step(s: Column, p: Column) -> Column:
        number = F.coalesce(*[F.when(p["kind"] == k, s[k] + 1) for k in EXPANSION])
        mark = F.concat(F.lit("<|"), kind(p), F.lit(":"), number.cast("string"), F.lit("|>"))
        own = F.struct(kind(p).alias("kind"), mark.alias("placeholder"), p["ref"].alias("ref"), F.coalesce(p["tokens"], default[kind(p)].cast("long")).alias("tokens"))
        seen = [(s[k] + F.when(p["kind"] == k, 1).otherwise(0)).alias(k) for k in EXPANSION]
        said = F.struct(s["done"].alias("done"), F.concat(s["run"], F.array(F.coalesce(p["text"], F.lit("")))).alias("run"), s["attachments"].alias("attachments"), *[s[k].alias(k) for k in EXPANSION])
        placed = F.struct(F.concat(s["done"], F.array(escape(F.array_join(s["run"], ""))), F.array(mark)).alias("done"), F.array().cast(texts).alias("run"), F.concat(s["attachments"], F.array(own)).alias("attachments"), *seen)
        return F.when(kind(p) == "text", said).otherwise(placed)

    def end(s: Column) -> Column:
        return F.struct(F.concat(F.array_join(s["done"], ""), escape(F.array_join(s["run"], ""))).alias("body"), s["attachments"].alias("attachments"))

    known = F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,tokens:bigint>>"))
    return F.aggregate(known, start, step, end)


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def formatted(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask (turn by turn: characters outside, then inside the mask), attachments, expanded_tokens.

    turns: conv_id, turn, role, parts.
    """
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("v"))
    row = F.struct("turn", "role", F.col("v.body").alias("body"), F.col("v.attachments").alias("attachments"))
    each = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    return each.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: F.when(t["role"].isin(*trained), F.struct(F.length(head(t)).alias("outside"), F.length(t["body"]).alias("inside"))).otherwise(F.struct((F.length(head(t)) + F.length(t["body"])).alias("outside"), F.lit(0).alias("inside")))).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars, from the formatted string and its mask alone."""
    split = F.slice(F.split("formatted", F.lit(r"\Q" + END + r"\E"), -1), 1, F.size("loss_mask"))
    # A mask entry counts from the end of the turn before, so each turn's span is cut from its own piece.
    pieces = made.withColumn("_pieces", F.arrays_zip(split.alias("piece"), F.col("loss_mask").alias("span")))
    role = lambda p: unescape(F.substring_index(F.substring(p, len(START) + 1, 2**31 - 1), SEP, 1))
    text = lambda p: unescape(F.substring(p, F.instr(p, SEP) + len(SEP), F.lit(2**31 - 1)))
    return pieces.select(
        "conv_id",
        F.transform("_pieces", lambda p: F.struct(role(p["piece"]).alias("role"), text(p["piece"]).alias("text"))).alias("turns"),
        F.array_join(F.transform("_pieces", lambda p: unescape(F.substring(p["piece"], p["span"]["outside"] + 1, p["span"]["inside"]))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_back(formatted(turns.withColumn("parts", text_part(F.col("text")))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


_E = r"""regexp_replace(replace({0}, '\', '\\'), '(<\|[A-Za-z0-9_:]*\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1 ', 'g')"""
OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_E.format("role")}) + length({_E.format("text")}) + {len(START + SEP + END)} AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
