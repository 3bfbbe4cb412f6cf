"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns up to it as text, and only that reply under the
loss mask. Turns are marked ``### role: text</turn>`` and a newline. Inside roles and texts the
characters the marks are made of are escaped, so that no text can forge a mark:
backslash -> ``\\b``, ``#`` -> ``\\h``, ``<`` -> ``\\l`` and, in roles, ``:`` -> ``\\c``.
After escaping, a backslash always starts one of these pairs, which makes the escape reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
REPLY_ROLE = "assistant"
#: Backslash first when escaping, last when unescaping.
TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def escaped(c: Column, pairs: tuple = TEXT_ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, pairs: tuple = TEXT_ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chats(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, example int (from 0), closes boolean, text, mask_start and mask_chars int (code
    points of the trainable reply in ``text``). Turns are ordered by turn (null first), then role,
    then text; repeated rows are repeated turns; null role or text counts as empty; null conv_id is
    one conversation. Where the last turn isn't a reply, a closing record with an empty mask holds
    all turns, so no turn is lost. An empty table gives no rows. A conversation's turns lie in one row and
    each of its examples repeats all turns before, so one conversation's turns have to fit a task's memory,
    and its output grows with the square of their number: that is the method.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    piece = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(BETWEEN), escaped(t["text"]), F.lit(CLOSE))
    conversations = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.size("ts").alias("n"),
        F.transform("ts", piece).alias("pieces"),
        F.transform("ts", lambda t: F.when(t["role"] == REPLY_ROLE, F.length(escaped(t["text"]))).otherwise(-1)).alias("replies"),
    )
    at_end = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.element_at("replies", i) >= 0) | (i == F.col("n")))
    targets = conversations.select("conv_id", "n", "pieces", "replies", F.posexplode(at_end).alias("example", "upto"))
    text = F.array_join(F.slice("pieces", F.lit(1), F.col("upto")), "")
    return targets.select(
        "conv_id", "example", (F.col("upto") == F.col("n")).alias("closes"), text.alias("text"), F.element_at("replies", F.col("upto")).alias("reply")
    ).select(
        "conv_id",
        "example",
        "closes",
        "text",
        (F.length("text") - len(CLOSE) - F.greatest("reply", F.lit(0))).alias("mask_start"),
        F.greatest("reply", F.lit(0)).alias("mask_chars"),
        (F.col("reply") >= 0).alias("trains"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), escapes undone."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")
    role = lambda p: F.substring_index(p, BETWEEN, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring(role(p), F.lit(len(OPEN) + 1), F.length(p)), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(p, F.length(role(p)) + len(BETWEEN) + 1, F.length(p))).alias("text"),
        ),
    )


def chat_digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, derived from formatted ``examples`` alone."""
    loss = unescaped(F.substring("text", F.col("mask_start") + 1, F.col("mask_chars")))
    turns = read_turns(F.col("text"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    each = examples.select(
        "conv_id",
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("closes"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(F.transform(turns, line), ""), 256).alias("sha"))).alias("whole"),
        F.struct("example", F.when(F.col("trains"), loss).otherwise("").alias("loss")).alias("part"),
    )
    joined = F.array_join(F.transform(F.sort_array("parts"), lambda p: p["loss"]), "")
    return each.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.collect_list("part").alias("parts"), F.sum("chars").alias("formatted_chars")).select(
        "conv_id",
        F.col("whole.n").alias("n_turns"),
        F.col("whole.sha").alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"),
        F.sha2(joined, 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts look like the template's marks.
TRICKY = (-7, "\\### Assistant: </turn> ok")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -7, writes the examples, and digests them as read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(TRICKY[1]).alias("text")
    extra = spark.range(2).select(F.lit(TRICKY[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat_digest(stored(format_chats(turns.unionByName(extra)), codec="zstd"))


OP3_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, 4 + 2 + 8
        + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c'))
        + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) AS chars,
        row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM marked
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
