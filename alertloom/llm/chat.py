"""Operator 4: chat formatting with Spark expressions only (native).

Template: `[INST] user [/INST]`, `<s> assistant </s>`, `<<SYS>> role: text <</SYS>>` for any other
role. Adjacent turns of one role stand in one block, parted by `[TURN]`, so they can be read back.
Control strings inside texts get one backslash after their first character; those that have
backslashes there already get one more. No escaped text holds a control string, and taking one
backslash away gives back the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAIL = r"(/?s>|/?INST\]|TURN\]|</?SYS>>)"
_PLAIN = r"([<\[])(\\*)" + _TAIL
_ESCAPED = r"([<\[])\\(\\*)" + _TAIL
_MARKS = r"\[INST\]|\[/INST\]|\[TURN\]|<s>|</s>|<<SYS>>|<</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role inside a system mark: percent signs, colons and line ends are written as %XX."""
    for char, code in (("%", "%25"), (":", "%3A"), ("\n", "%0A")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return escape(role)


def _role_in(role: Column) -> Column:
    role = unescape(role)
    for char, code in (("\n", "%0A"), (":", "%3A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    loss_spans holds, for every assistant text, the code points skipped since the last span and the
    code points kept. Turns are sorted as collected structs (by turn, nulls first, then role, then
    text, so ties have a fixed order; repeated rows stay). Null texts and roles are empty. One
    conversation is one output row, so its turns meet in one task; nothing else does. A null
    conversation id is a conversation of its own, and an empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    # adjacent turns of one role become one block with an array of texts
    role_at = lambda i: F.element_at("t", i + 1)["role"]
    blocks = sorted_turns.select(
        "conv_id",
        _runs(
            F.size("t"),
            lambda i: role_at(i) != role_at(F.greatest(i - 1, F.lit(0))),
            lambda first, after: F.struct(
                role_at(first).alias("role"),
                F.transform(F.slice("t", first + 1, after - first), lambda x: escape(x["text"])).alias("texts"),
            ),
        ).alias("blocks"),
    )

    def piece(b: Column) -> Column:
        body = F.array_join(b["texts"], "[TURN]")
        return (
            F.when(b["role"] == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
            .when(b["role"] == "assistant", F.concat(F.lit("<s> "), body, F.lit(" </s>")))
            .otherwise(F.concat(F.lit("<<SYS>> "), _role_out(b["role"]), F.lit(": "), body, F.lit(" <</SYS>>")))
        )

    pieces = blocks.select("conv_id", "blocks", F.transform("blocks", piece).alias("pieces"))
    own = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda i: F.element_at("blocks", i + 1)["role"] == "assistant")
    own = F.when(F.size("blocks") > 0, own).otherwise(F.array().cast("array<int>"))

    # in front of an assistant block stand the end mark of the last one and all blocks between
    def spans(own: Column) -> Column:
        def of_block(i: Column, j: Column) -> Column:
            last = F.when(j > 0, F.element_at(own, j)).otherwise(-1)
            between = F.aggregate(F.slice("pieces", last + 2, i - last - 1), F.lit(0), lambda n, x: n + F.length(x))
            gap = between + F.when(j > 0, 5).otherwise(0)
            return F.transform(
                F.element_at("blocks", i + 1)["texts"],
                lambda x, k: F.struct(F.when(k == 0, gap + 4).otherwise(6).alias("skip"), F.length(x).alias("keep")),
            )

        return F.flatten(F.transform(own, of_block))

    return pieces.select("conv_id", "blocks", "pieces", own.alias("own")).select(
        "conv_id", F.array_join("pieces", "").alias("formatted"), spans(F.col("own")).alias("loss_spans")
    )


def _runs(n: Column, begins: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """make(first, after) for each run of the indices 0 to n - 1; a run begins at 0 and wherever begins(i) holds.
    Linear in n: the starts are found by index, no array grows element by element."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | begins(i))
    return F.transform(
        F.arrays_zip(starts.alias("first"), F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n)).alias("after")),
        lambda run: make(run["first"], run["after"]),
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, read from its marks."""
    parts = F.split(formatted, rf"(?={_MARKS})")

    opened = F.filter(parts, lambda p: p.rlike(r"^(\[INST\]|<s>|<<SYS>>|\[TURN\])"))
    closed = F.filter(parts, lambda p: p.rlike(r"^(\[/INST\]|</s>|<</SYS>>|\[TURN\])"))

    # every opening part is followed by the part that closes it; its text loses the blank there
    both = F.arrays_zip(opened.alias("o"), closed.alias("c"))

    def cut(x: Column) -> Column:
        mark = F.when(x["o"].startswith("[INST]") | x["o"].startswith("[TURN]"), 7).when(x["o"].startswith("<s>"), 5).otherwise(9)
        mark = mark + x["o"].startswith("[INST]").cast("int")
        raw = F.substr(x["o"], mark)
        return F.when(x["c"].startswith("[TURN]"), raw).otherwise(F.substr(raw, F.lit(1), F.length(raw) - 1))

    # [TURN] opens a further text of the role before it
    def turns(parts: Column) -> Column:
        at = lambda i: F.try_element_at(parts, i + 1)

        def run(first: Column, after: Column) -> Column:
            head = at(first)
            name = F.substring_index(cut(head), ": ", 1)
            other = head["o"].startswith("<<SYS>>")
            role = F.when(head["o"].startswith("[INST]"), "user").when(head["o"].startswith("<s>"), "assistant").otherwise(_role_in(name))
            return F.transform(
                F.slice(parts, first + 1, after - first),
                lambda x, k: F.struct(
                    role.alias("role"),
                    unescape(F.when(other & (k == 0), F.substr(cut(x), F.length(name) + 3)).otherwise(cut(x))).alias("text"),
                ),
            )

        return F.flatten(_runs(F.size(parts), lambda i: ~at(i)["o"].startswith("[TURN]"), run))

    return F.element_at(F.transform(F.array(both), turns), 1)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: span by span, nothing between."""

    def step(state: Column, s: Column) -> Column:
        at = state["at"] + s["skip"]
        return F.struct(
            F.concat(state["texts"], F.array(unescape(F.substr(formatted, at, s["keep"])))).alias("texts"),
            (at + s["keep"]).alias("at"),
        )

    start = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(1).alias("at"))
    return F.array_join(F.aggregate(spans, start, step)["texts"], "")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    probe = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{says}'), (-1L, 1L, 'assistant', '{says}') AS t(conv_id, turn, role, text)"
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_chats(rows)
    read = out.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Formatted length from the turns alone: marks by block (user 15, assistant 9, other 18 + role), 6 per
#: inner turn, and one backslash for each control string of a text.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS inner_turn FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|TURN\]|</?SYS>>)'))
      + CASE WHEN inner_turn THEN 6 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 9
             ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
