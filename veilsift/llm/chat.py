"""Chat formatting (operator 1): conversations to training text and back, Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings, in the order in which texts are escaped.
OPEN, MORE, CLOSE = "### ", "</more>", "</turn>"
#: Inside texts: what is replaced, and by what. Backslashes go first and come back last, so a
#: backslash in formatted text always starts one of these pairs.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), (MORE, "\\m"), (CLOSE, "\\t"), ("\n", "\\n"))
CHUNK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an expression is computed per item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escaped(text: Column, role: bool = False) -> Column:
    """Text in which no control string stands; roles, which end with their line, lose line ends, too."""
    for plain, mark in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    """The text as it was before ``escaped``."""
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def merged_turns(turns: Column) -> Column:
    """Neighbouring turns of one role as one block: role and its texts, in order.

    Finds the places where the role changes and slices there, so that time is linear in
    the number of turns.
    """
    n = F.size(turns)
    places = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    return bound(F.when(n > 0, places).otherwise(F.array().cast("array<int>")), lambda starts: F.transform(
        starts,
        lambda start, k: F.struct(
            F.get(turns, start)["role"].alias("role"),
            F.transform(
                F.slice(turns, start + 1, F.coalesce(F.get(starts, k + 1), n) - start),
                lambda t: t["text"],
            ).alias("texts"),
        ),
    ))


def block_text(block: Column) -> Column:
    """One block in the template."""
    body = F.array_join(F.transform(block["texts"], lambda t: escaped(t)), MORE)
    return F.concat(F.lit(OPEN), escaped(block["role"], True), F.lit("\n"), body, F.lit(CLOSE + "\n"))


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it; adds up in chunks, so that
    no growing array is copied once per value."""
    def run(numbers: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("before"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(numbers, start, lambda a, x: F.struct(
            F.concat(a["before"], F.array(a["total"])).alias("before"), (a["total"] + x).alias("total")
        ))

    chunks = F.when(F.size(values) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        lambda c: run(F.slice(values, c * CHUNK + 1, F.lit(CHUNK))),
    ))
    return F.coalesce(
        bound(chunks, lambda done: F.flatten(F.zip_with(
            done, run(F.transform(done, lambda c: c["total"]))["before"],
            lambda c, base: F.transform(c["before"], lambda b: b + base),
        ))),
        F.array().cast("array<long>"),
    )


def loss_spans(blocks: Column, roles: tuple[str, ...]) -> Column:
    """Spans of the formatted text that count for the loss, one for each text: (start, length)
    in code points. No span has a control string."""
    def of_block(block: Column, start: Column) -> Column:
        body = start + F.lit(len(OPEN) + 1) + F.length(escaped(block["role"], True))
        before = sums_before(F.transform(block["sizes"], lambda n: n + F.lit(len(MORE)).cast("long")))
        return bound(body, lambda at_body: F.zip_with(before, block["sizes"], lambda at, n: F.struct(
            (at_body + at).cast("long").alias("start"), n.alias("length")
        )))

    none = F.array().cast("array<struct<start: long, length: long>>")
    starts = sums_before(F.transform(blocks, lambda b: F.length(b["shown"]).cast("long")))
    return F.flatten(F.zip_with(
        blocks, starts, lambda b, at: F.when(b["role"].isin(*roles), of_block(b, at)).otherwise(none)
    ))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, one span after the other, nothing between.

    Spans are cut out chunk by chunk, so that not every one is counted off from the start.
    """

    def chunk(text: Column, part: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.element_at(part, -1)
        cut = F.substring(
            text, (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int")
        )
        return bound(F.struct(cut.alias("text"), first["start"].alias("at")), lambda c: F.array_join(
            F.transform(part, lambda s: unescaped(
                F.substring(c["text"], (s["start"] - c["at"] + 1).cast("int"), s["length"].cast("int"))
            )), "",
        ))

    def joined(text: Column, all_spans: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / CHUNK).cast("int"))
        parts = F.transform(places, lambda c: bound(
            F.slice(all_spans, c * CHUNK + 1, F.lit(CHUNK)), lambda part: chunk(text, part)
        ))
        return F.when(F.size(all_spans) == 0, "").otherwise(F.array_join(parts, ""))

    return bound(formatted, lambda text: bound(spans, lambda all_spans: joined(text, all_spans)))


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``.

    Turns are ordered by turn, then role, then text (nulls first), so ties have one order.
    Neighbours of one role become one block ``### role``, a line end, the texts with
    ``</more>`` between, ``</turn>`` and a line end; control strings inside texts are
    escaped so that ``parsed_turns`` gets every row's text back. ``loss_spans`` (start,
    length, in code points of ``formatted``) cover each text of a loss role, and nothing else.

    Null text and null roles count as empty. Rows with a null conversation are one
    conversation. Repeated rows are turns of their own. No rows, no conversations. Other
    columns are ignored. A conversation's rows meet in one task, since its text is one
    value of the result; conversations are dealt by a hash of their id.
    """
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    blocks = collected.select("conv_id", merged_turns(F.col("turns")).alias("blocks"))
    shown = blocks.select("conv_id", F.transform(
        "blocks", lambda b: F.struct(
            b["role"].alias("role"), block_text(b).alias("shown"),
            F.transform(b["texts"], lambda t: F.length(escaped(t)).cast("long")).alias("sizes"),
        )
    ).alias("blocks"))
    return shown.select(
        "conv_id", F.array_join(F.transform("blocks", lambda b: b["shown"]), "").alias("formatted"),
        loss_spans(F.col("blocks"), loss_roles).alias("loss_spans"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order; the inverse of the format."""
    shown = F.filter(
        F.split(formatted, r"\Q" + CLOSE + "\n" + r"\E", -1), lambda b: b != ""
    )
    def turns(block: Column) -> Column:
        role_end = F.instr(block, "\n")
        role = unescaped(F.substring(block, F.lit(len(OPEN) + 1), role_end - len(OPEN) - 1))
        body = F.substring(block, role_end + 1, F.length(block))
        return F.transform(
            F.split(body, r"\Q" + MORE + r"\E", -1),
            lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")),
        )

    return F.flatten(F.transform(shown, turns))


#: A conversation whose texts hold the template's own control strings (a fixed row of the query).
HOSTILE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast(table.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(table.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"),
    )
    formatted = format_chats(table.unionByName(extra))
    said = formatted.select(
        "conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    told = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    ), "")
    return said.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str, role: bool = False) -> str:
    for plain, mark in ESCAPES if role else ESCAPES[:-1]:
        old = "chr(10)" if plain == "\n" else f"'{plain}'"
        text = f"replace({text}, {old}, '{mark}')"
    return text


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}'
),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped('text')}) + CASE WHEN opens
    THEN length({_sql_escaped('role', True)}) + {len(OPEN) + len(CLOSE) + 2} ELSE {len(MORE)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
