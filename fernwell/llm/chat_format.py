"""Chat formatting with Spark expressions only.

Template. A turn opens with ``<|im_start|>``, its role and a line feed; its text follows; ``<|im_end|>`` and a line feed
close it. Adjacent turns of one role are merged into one such block, in which ``<|next|>`` stands between their texts, so
every turn can be read back. Inside roles and texts ``&`` is written ``&amp;`` and ``<|`` is written ``&lt;|`` (a line
feed in a role: ``&nl;``); no control string can then appear in them, and undoing the two in the other order gives the
text back, whatever it holds.

Plan. One aggregation collects the (turn, role, text) structs of a conversation; the rest are array expressions over
that row: sort, find where the role changes, slice each run, join. All of them are linear in the conversation's length.
A conversation is one row by definition, so its memory is that of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|next|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_col``, ``segments`` and ``formatted``.

    ``segments`` is an array of (text, loss) whose texts, joined, are ``formatted``; the loss mask covers the texts of
    ``loss_role`` and nothing else. Null roles and texts count as empty. Rows are ordered by turn (null first), then role,
    then text, so that ties and repeated rows have one order; repeated rows are turns of their own. A null conversation
    id is a conversation. No rows: no conversations. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    opens = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    # the end of a run is the start of the next one
    runs = F.zip_with("opens", F.concat(F.slice("opens", 2, F.greatest(F.size("opens") - 1, F.lit(0))), F.array(F.size("ts"))), lambda a, b: F.slice("ts", a + 1, b - a))

    def block(run: Column) -> Column:
        role = run[0]["role"]
        loss = role == loss_role
        head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
        part = lambda text, masked: F.struct(text.alias("text"), masked.alias("loss"))
        texts = F.flatten(F.transform(run, lambda t, i: F.array(part(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), part(escape(t["text"]), loss))))
        return F.concat(texts, F.array(part(F.lit(END), F.lit(False))))

    return (
        sorted_turns.withColumn("opens", opens)
        .select("conv", F.flatten(F.transform(runs, block)).alias("segments"))
        .select(F.col("conv").alias(conv_col), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, as they were."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring(b, F.lit(len(START) + 1), F.length(b))
        cut = F.instr(body, "\n")
        role = unescape(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit("&nl;"), F.lit("\n")))
        texts = F.split(F.substring(body, cut + 1, F.length(body)), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests read back from ``formatted`` and ``segments``."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = formatted.select(conv_col, "formatted", parse(F.col("formatted")).alias("turns"), loss.alias("loss_text"))
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
