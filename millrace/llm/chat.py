"""Chat formatting with DataFrame expressions alone.

Rows of a conversation are collected as structs and sorted by turn; adjacent turns of one role become one block, and
the blocks are joined to one string:

    <|user|>
    first text<|next|>a second turn of the same role<|end|>
    <|assistant|>
    answer<|end|>

Marks begin with "<|", and no text can hold that: a backslash is doubled and "<|" becomes "<\\|", so the turns can be
read back exactly. Role names have their own codes, since a newline ends the head of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256
NEXT, END = "<|next|>", "<|end|>\n"
ROLE_CODES = [("%", "%25"), ("\n", "%0A"), ("|", "%7C")]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """Percent-style, as roles are short: no "<|", newline or backslash is left in them."""
    for char, code in ROLE_CODES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans (array of start and length in characters from 0, of
    each learn_role text in its escaped form), n_turns.

    Rows are ordered by turn (null first), ties by role, then text; repeated rows are turns of their own. A null text
    or role counts as empty. A row with a null conversation is a conversation of its own, so that such rows, however many,
    never meet in one group. A conversation is one output row, so it has to fit in memory; there is no limit on their
    number. Other columns are left out. No rows give none.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    convs = rows.groupBy(F.col(conv_col).alias("conv_"), alone.alias("alone_")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # What stands before and after each text depends on whether its neighbours have the same role.
    roles = convs.withColumn("roles", F.col("turns.role"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("roles", 1, F.size("roles") - 1))
    after = F.concat(F.slice("roles", 2, F.size("roles")), F.array(F.lit(None).cast("string")))
    parts = F.transform(F.arrays_zip(F.col("turns"), before.alias("before"), after.alias("after")), lambda z: F.struct(
        F.when(z["before"].eqNullSafe(z["turns"]["role"]), F.lit("")).otherwise(
            F.concat(F.lit("<|"), escape_role(z["turns"]["role"]), F.lit("|>\n"))).alias("head"),
        escape(z["turns"]["text"]).alias("body"),
        F.when(z["after"].eqNullSafe(z["turns"]["role"]), F.lit(NEXT)).otherwise(F.lit(END)).alias("tail"),
        (z["turns"]["role"] == learn_role).alias("learn")))
    placed = roles.select("conv_", F.explode(F.array(parts)).alias("parts"))
    # Places are summed in runs of RUN turns, so that a conversation of very many turns copies no growing list at each.
    size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long")
    total = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, p: a + size(p))
    nothing = F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)")

    def spans_of(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), nothing.alias("spans")), lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")))["spans"]

    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("parts") / RUN).cast("int") - 1), lambda k: F.slice("parts", k * RUN + 1, RUN))
    placed = placed.withColumn("runs", runs)
    placed = placed.withColumn("sums", F.transform("runs", total))
    starts = F.aggregate("sums", F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    placed = placed.withColumn("spans", F.flatten(F.zip_with("runs", F.slice(starts, 1, F.size("runs")), spans_of)))
    return placed.select(
        F.col("conv_").alias(conv_col),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.col("spans").alias("loss_spans"), F.size("parts").cast("long").alias("n_turns"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"(?<=<\|end\|>)\n", -1), lambda b: b != "")
    turns = F.transform(blocks, lambda b: F.transform(
        F.split(F.regexp_extract(b, r"(?s)^<\|[^\n]*\|>\n(.*)<\|end\|>$", 1), r"<\|next\|>", -1),
        lambda t: F.struct(unescape_role(F.regexp_extract(b, r"^<\|([^\n]*)\|>\n", 1)).alias("role"), unescape(t).alias("text"))))
    return F.flatten(turns)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
