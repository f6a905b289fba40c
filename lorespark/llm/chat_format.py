"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
are merged into a block by functions over the array; blocks are concatenated::

    <s>ROLE[INST]TEXT[SEP]TEXT[/INST]</s>     one block; [SEP] stands between its turns

Inside roles and texts a backslash is doubled and every control string gets a backslash after
its first character, so that no control string is left. Dropping each backslash that stands
before another character undoes both, so that texts come back exactly. The loss mask covers
the texts of ``loss_role`` and nothing of the markup.

Order: by turn, then role, then text; null turns come first. A null role counts as ``user``,
a null text as empty. Rows that repeat a turn are turns of their own. A null conversation id
is a conversation. Other columns are ignored. A conversation is one row of output, so it is
gathered in one place; only its own turns are. Time grows with the turns times their root at most. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, BEGIN, SEP, END, CLOSE = "<s>", "[INST]", "[SEP]", "[/INST]", "</s>"
CONTROL = (OPEN, BEGIN, SEP, END, CLOSE)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chunks(array: Column) -> Column:
    """An array's parts of about the root of its size, so that steps over each part and over the parts stay short."""
    size = F.greatest(F.ceil(F.sqrt(F.size(array))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(array) / size).cast("int") - 1, F.lit(0))), lambda i: F.slice(array, i * size + 1, size))


def running(df: DataFrame, lengths: str, name: str) -> DataFrame:
    """Adds the sum of what stands before each length; arrays grow by parts, as appending copies them.

    Each step is a column of its own, so that nothing is computed again inside a function over an array.
    """
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("starts"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
    df = df.withColumn("chunks", chunks(F.col(lengths)))
    df = df.withColumn("within", F.transform("chunks", lambda c: F.aggregate(c, zero, step)))
    df = df.withColumn("before", F.aggregate("within", zero, lambda s, w: step(s, w["at"]), lambda s: s["starts"]))
    return df.withColumn(name, F.flatten(F.zip_with("within", "before", lambda w, at: F.transform(w["starts"], lambda x: x + at)))).drop("chunks", "within", "before")


def chat_format(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` (start and end in code points, end exclusive, of each text with loss)."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # adjacent turns of a role are one block: its first turn opens it, its last one closes it, others stand behind a separator
    role = lambda i: F.get("t", i)["role"]
    turns = turns.withColumn("t", F.transform("t", lambda x, i: F.struct(
        F.when((i == 0) | (role(i - 1) != x["role"]), F.concat(F.lit(OPEN), escape(x["role"]), F.lit(BEGIN))).otherwise(F.lit(SEP)).alias("before"),
        escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss"),
        F.when((i == F.size("t") - 1) | (role(i + 1) != x["role"]), F.lit(END + CLOSE)).alias("after"),
    )))
    # pieces: markup and texts in order, each with whether it has loss
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    turns = turns.select("conv_id", F.flatten(F.transform("t", lambda x: F.filter(
        F.array(piece(x["before"], F.lit(False)), piece(x["text"], x["loss"]), piece(x["after"], F.lit(False))), lambda p: p["s"].isNotNull(),
    ))).alias("pieces"))
    turns = turns.withColumn("lengths", F.transform("pieces", lambda p: F.char_length(p["s"]).cast("bigint")))
    turns = running(turns, "lengths", "starts")
    spans = F.filter(
        F.zip_with("pieces", "starts", lambda p, at: F.when(p["loss"], F.struct(at.alias("start"), (at + F.char_length(p["s"])).alias("end")))),
        lambda s: s.isNotNull(),
    )
    return turns.select("conv_id", F.array_join(F.col("pieces")["s"], "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"\[/INST\]</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        # role and texts as the element of an array, so that a block is cut once and not for each turn
        parts = F.array(F.split(F.substring(b, F.lit(len(OPEN) + 1), F.char_length(b)), r"\[INST\]", 2))
        return F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.get(p, F.lit(1)), r"\[SEP\]"), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text")))))

    return F.flatten(F.transform(blocks, turns))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined with nothing between them.

    Places are counted from the start of a string, so each part of the spans is cut out first.
    """

    def cut(text: Column, start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def part(c: Column) -> Column:
        first = F.get(c, F.lit(0))["start"]
        # as the element of an array, the part is cut out once and not for each span
        text = F.array(cut(formatted, first, F.element_at(c, -1)["end"]))
        return F.flatten(F.transform(text, lambda x: F.transform(c, lambda s: unescape(cut(x, s["start"] - first, s["end"] - first)))))

    return F.array_join(F.flatten(F.transform(F.filter(chunks(spans), lambda c: F.size(c) > 0), part)), "")
