"""Operator 1 against a plain model and its SQL twin."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from veilsift.llm import chat

ROWS = [
    (1, 0, "user", "hi </turn> \\t ### x"), (1, 1, "assistant", "a\nb"), (1, 2, "assistant", "</more>\\m\\\\"),
    (1, 3, "user", None), (2, 1, "assistant", ""), (2, 0, "system", "####### \\h"), (2, 1, "assistant", "tie"),
    (3, 0, None, "no role"), (3, 1, "role\nwith line ### end", "x"), (None, 0, "user", "no id"),
    (4, None, "user", "no turn"), (4, 0, "user", "later"), (5, 0, "user", "same"), (5, 0, "user", "same"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn(
        "formatted", F.lit("clash")
    )


def model(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        out[conv] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
    return out


def test_round_trip_and_mask(spark):
    df = chat.format_chats(frame(spark)).withColumns({
        "turns": chat.parsed_turns(F.col("formatted")),
        "loss": chat.masked_text(F.col("formatted"), F.col("loss_spans")),
    })
    got = {r.conv_id: r for r in df.collect()}
    want = model(ROWS)
    assert set(got) == set(want)
    for conv, turns in want.items():
        row = got[conv]
        assert [(t.role, t.text) for t in row.turns] == turns
        blocks = sum(k == 0 or turns[k - 1][0] != t[0] for k, t in enumerate(turns))
        assert row.formatted.count(chat.OPEN) == row.formatted.count(chat.CLOSE) == blocks
        masked = [row.formatted[s.start:s.start + s.length] for s in row.loss_spans]
        assert not any(c in m for m in masked for c in (chat.OPEN, chat.MORE, chat.CLOSE))
        assert len(masked) == sum(r == "assistant" for r, _ in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        undo = lambda s: s.replace("\\n", "\n").replace("\\t", chat.CLOSE).replace("\\m", chat.MORE) \
            .replace("\\h", "###").replace("\\s", "\\")
        assert "".join(map(undo, masked)) == loss == row.loss


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", f"text {k}") for k in range(1500)]
    row = chat.format_chats(frame(spark, rows)).withColumn("turns", chat.parsed_turns(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in row.turns] == [(r[2], r[3]) for r in rows]
    spans = [row.formatted[s.start:s.start + s.length] for s in row.loss_spans]
    assert spans == [r[3] for r in rows if r[2] == "assistant"]


def test_long_texts_of_one_role(spark):
    """A third of all rows is one conversation, with a very long text in it."""
    rows = [(1, k, "assistant", f"é{k} </more> \\m") for k in range(3000)] + [(1, 3000, "assistant", "y\n###" * 400_000)]
    row = chat.format_chats(frame(spark, rows)).select(
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("loss_spans").alias("n")
    ).first()
    assert row.n == 3001 and row.loss == "".join(r[3] for r in rows)


def test_the_query_reads_the_loss_through_the_mask(spark, tmp_path):
    frame(spark).drop("formatted").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat.op1_chat_format(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "loss_spans" in plan


def test_empty(spark):
    assert chat.format_chats(frame(spark).limit(0)).count() == 0


def test_query_and_twin(spark, tmp_path):
    rows = [r for r in ROWS if r[0] not in (2, 5)]
    frame(spark, rows).drop("formatted").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == {r[0]: r for r in con.execute(chat.OP1_SQL).fetchall()}
    for conv, turns in model([*rows, (-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)]).items():
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[conv][1:3] == (len(turns), hashlib.sha256(told.encode()).hexdigest())
