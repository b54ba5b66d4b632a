"""Chat formatting by prefix-target expansion.

Method: every assistant turn becomes an example of its own whose context is all turns before it and whose only
trainable text is that reply. A conversation that does not end with an assistant turn adds a closing example without
trainable text, so that every turn can be read back from the output.

Only DataFrame functions; one shuffle brings a conversation's turns together. A conversation is one training unit, so
it must fit in a row; its size is bounded by its context window, not by the table.

A turn is written START role newline text END newline. The role is URL-encoded; in texts a backslash is doubled and each control string
is broken by a backslash after its first character, which `unescape` takes back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>"
#: Control strings of this and of other common templates.
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


_BREAK = "|".join(f"{re.escape(first)}(?={'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)})" for first in sorted({c[0] for c in CONTROLS}))


def escape(text: Column) -> Column:
    """text without any control string, reversibly; texts without such characters, as most are, cost one search."""
    broken = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_BREAK})", "$1\\\\")
    return F.when(text.rlike(r"[\\<\[]"), broken).otherwise(text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|s/I<])", "$1")


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per assistant turn and per unanswered end of a conversation.

    Columns: conv_id, example (place of its last turn), n_turns, formatted, loss_start and loss_chars (the code points of
    formatted under the loss mask; none in a closing example). Turns are in order of turn (null first), then role, then
    text; repeated rows are turns of their own. Null roles and texts count as empty. Rows without conv_id form one
    conversation. An empty table has no examples; other columns are ignored.
    """
    clean = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(clean)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    ends = F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i + 1))
    # every turn is written once per conversation, below the explode, and examples only join what is written
    written = whole.select(
        "conv_id",
        F.filter(ends, lambda i: i.isNotNull()).alias("ends"),
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), head(t).alias("head"), escape(t["text"]).alias("text"))).alias("turns"),
    )
    written = written.withColumn("pieces", F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))))
    each = written.select("conv_id", "turns", "pieces", F.explode("ends").alias("i"))
    last = F.get("turns", F.col("i") - 1)
    each = each.select("conv_id", "pieces", "i", last["head"].alias("head"), last["text"].alias("target"), last["reply"].alias("trainable"))
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("i") - 1), "")
    context = F.concat(before, "head")
    reply, target = F.col("trainable"), F.col("target")
    return each.select(
        "conv_id",
        (F.col("i") - 1).cast("long").alias("example"),
        F.col("i").cast("long").alias("n_turns"),
        F.concat(context, target, F.lit(END + "\n")).alias("formatted"),
        F.when(reply, F.length(context)).otherwise(0).cast("long").alias("loss_start"),
        F.when(reply, F.length(target)).otherwise(0).cast("long").alias("loss_chars"),
        reply,
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n", ""), r"<\|end\|>\n$", "")).alias("text"),
        ),
    )


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, what is under the loss mask, and characters written.

    Nulls, ties, repeated rows and empty tables as in examples; a conversation without replies has empty loss.
    """
    made = examples(turns)
    loss = F.when(F.col("trainable"), unescape(F.expr("substring(formatted, int(loss_start) + 1, int(loss_chars))")))
    whole = made.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    read = whole.withColumn("read", read_turns(F.col("longest"))).withColumn("text", text)
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("text").cast("long").alias("loss_chars"),
        F.sha2("text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def oracle(extra: list[tuple[int, int, str, str]]) -> str:
    """The digest of `conversations` and some more turns in SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    more = ", ".join(f"({c}::BIGINT, {t}::BIGINT, {quote(r)}, {quote(x)})" for c, t, r, x in extra)
    escaped = "replace(text, '\\', '\\\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, {quote(c)}, {quote(c[0] + chr(92) + c[1:])})"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {more}))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length({quote(START)} || url_encode(role) || chr(10) || {escaped} || {quote(END)} || chr(10)) AS chars FROM r),
a AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    (sum(so_far) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars FROM a GROUP BY conv_id"""
