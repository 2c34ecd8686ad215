r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own,
with all preceding turns as context and only that reply trainable. Native: DataFrame functions only.

A conversation is formatted once; an example names its context as a prefix of that text (its length)
and its target as a span, the loss mask. `expand` makes a row of every example and cuts its target out of the
formatted text by the mask; it does not copy prefixes, whose sum grows with the square of the turns. `examples`
adds them where texts are wanted.

Template of a turn: `### <role>: <text></turn>\n`. Control strings inside texts and roles are escaped
reversibly: `\` becomes `\0`, then `###` becomes `\1`, `</turn>` becomes `\2`, and in roles `: ` becomes `\3`.
After the first step each backslash is followed by 0, so the other codes are unambiguous.

Defined results. Null text or role: empty. Turns are in order of turn (null first), then role, then
text; ties and repeated rows therefore stay, in that order. A null conv_id is a conversation too.
No assistant turn: no example, empty loss. Empty table: no rows of its own. Other columns are not read.
A conversation must fit in a row (2 GB), as its digest needs it in sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\3"))
TRAINABLE = "assistant"
#: Elements whose running sums are taken at once.
BLOCK = 256


def escape(text: Column, codes=ESCAPES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=ESCAPES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def running_sums(sizes: Column) -> Column:
    """Of an array of bigint, the sum of all elements before each one.

    In blocks, as an array that grows by one element is copied each time."""
    none = F.expr("cast(array() as array<bigint>)")

    def sums(block: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
        return F.aggregate(block, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["found"], s["at"]).alias("found")))

    def placed(inside: Column) -> Column:
        return F.flatten(F.zip_with(inside, sums(F.transform(inside, lambda x: x["at"]))["found"], lambda x, at: F.transform(x["found"], lambda y: y + at)))

    def blocks(x: Column) -> Column:
        last = F.greatest(F.size(x) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last, F.lit(BLOCK)), lambda i: F.slice(x, i + 1, BLOCK))

    # each step's result is an element of an array, so that it is computed once
    return F.transform(F.transform(F.transform(F.array(sizes), blocks), lambda x: F.transform(x, sums)), placed)[0]


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, examples: array of (turn_index, context_chars, loss_start, loss_chars), in code points from 0."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def piece(t):
        head = F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(COLON))
        body = escape(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(END)).alias("piece"),
            F.char_length(head).alias("head"),
            F.char_length(body).cast("bigint").alias("body"),
            (t["role"] == TRAINABLE).alias("trainable"),
        )

    cut = grouped.select("conv_id", F.transform("turns", piece).alias("p"))
    sums = running_sums(F.transform("p", lambda x: x["head"] + x["body"] + len(END)))
    cut = cut.select("conv_id", "p", sums.alias("at"))

    def example(x, i):
        at = F.get("at", i)
        return F.when(x["trainable"], F.struct(
            i.alias("turn_index"), at.alias("context_chars"), (at + x["head"]).alias("loss_start"), x["body"].alias("loss_chars")
        ))

    return cut.select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.array_compact(F.transform("p", example)).alias("examples")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, examples, pieces (the turns as formatted), starts (of each in the text), turns: array of (role, text)."""
    pieces = F.split(F.col("formatted"), END, -1)
    cut = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))

    def turn(x):
        role = F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), COLON, 1)
        body = F.substr(x, F.lit(len(HEAD) + len(COLON) + 1) + F.char_length(role))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    starts = running_sums(F.transform("pieces", lambda x: F.char_length(x).cast("bigint") + len(END)))
    return cut.select("conv_id", "formatted", "examples", "pieces", starts.alias("starts"), F.transform("pieces", turn).alias("turns"))


def expand(parsed: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, conv_id, example, e (its spans) and target: one row for each assistant turn, and one without
    example for a conversation that has none.

    The target is what lies under the mask in the formatted text. A mask must begin in the turn that its context
    ends before and may not reach beyond it; others are an error."""

    def one(e):
        i = e["turn_index"]
        return F.struct(e.alias("e"), F.get("pieces", i).alias("piece"), F.get("starts", i).alias("start"))

    rows = parsed.select("conv_id", *keep, F.posexplode_outer(F.transform("examples", one)).alias("example", "x"))
    e, inside = F.col("x.e"), F.col("x.e.loss_start") - F.col("x.start")
    right = (e["context_chars"] == F.col("x.start")) & (inside >= 0) & (e["loss_chars"] >= 0) & (inside + e["loss_chars"] <= F.char_length("x.piece"))
    cut = F.substring(F.col("x.piece"), (inside + 1).cast("int"), e["loss_chars"].cast("int"))
    target = F.when(right, cut).when(F.col("example").isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("a loss mask does not fit its turn")))
    return rows.select("conv_id", *keep, "example", e.alias("e"), target.alias("target"))


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, example, prompt, target (both as formatted): one row for each assistant turn."""
    rows = expand(parse(formatted), "formatted").filter("example IS NOT NULL")
    prompt = F.substring("formatted", F.lit(1), F.col("e.loss_start").cast("int"))
    return rows.select("conv_id", "example", prompt.alias("prompt"), "target")


def losses(parsed: DataFrame, *keep: str) -> DataFrame:
    """conv_id, the columns keep (of one value for a conversation) and loss: array of the unescaped targets, in order."""
    rows = expand(parsed, *keep).withColumn("text", unescape(F.col("target")))
    said = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "text"))))
    return rows.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in keep], F.transform(said, lambda x: x["text"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, examples, turns: array of (role, text), loss: array of texts, each read through its mask and unescaped."""
    parsed = parse(formatted)
    loss = losses(parsed).select(F.col("conv_id").alias("id"), "loss")
    return parsed.join(loss, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", "formatted", "examples", "turns", "loss")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    one = lambda n, role: spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.lit(n).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")
    )
    return one(0, "user").unionByName(one(1, "assistant"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    parsed = parse(format_conversations(turns.unionByName(probe(spark))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = parsed.select(
        "conv_id", "examples", "pieces", "starts",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("examples").cast("long").alias("n_examples"),
    )
    loss = F.array_join("loss", "")
    return losses(whole, "n_turns", "turns_sha256", "formatted_chars", "n_examples").select(
        "conv_id", "n_turns", "turns_sha256",
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS body,
  replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ': ', '\3') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
