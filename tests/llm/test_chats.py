import duckdb
import pytest

from heirflow.llm import chats

SCHEMA = "conv_id long, turn int, role string, text string"
ROWS = [
    (1, 0, "user", "How does rain form?\nI never knew."),
    (1, 1, "assistant", "> How does rain form?\nDrops grow until they fall."),
    (1, 2, "user", "Another thing: why is the sky blue?"),
    (1, 3, "user", "On Monday A wrote:\n>> how  does rain FORM?\n> Drops grow until they fall.\n\nThanks, clear."),
    (1, 4, "assistant", ">another thing: why is\n> the sky blue?\nScattering."),
    (1, 5, "user", "> Scattering.\n> unknown words\nOh."),
    (2, 0, "user", "> Scattering.\nquoted from elsewhere"), (2, 1, None, None), (2, 2, "user", ""), (2, 2, "user", ""),
    (3, 0, "user", "ok"), (3, 1, "assistant", "ok"), (3, 2, "user", "> ok\nwhich one?"), (3, 2, "system", "> > ok\nnested"),
    (4, 0, "user", "> only a quote"), (4, 700, "user", "late"), (4, 1, "user", "  >  not\t>quoted > inside\n\n\n"),
    (None, 0, "user", "no conversation"), (None, None, "user", "> no conversation\nno turn"), (None, 2, "user", "> no conversation"),
    (5, 3, "user", "a > b\n" * 50), (5, 4, "user", "> a > b\n" * 3 + "yes"),
]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


def test_links_and_order(given):
    rows = {(r.conv_id, r.turn, r.role): r for r in chats.threaded(given).collect()}
    assert rows[1, 1, "assistant"].reply_to == 0 and rows[1, 1, "assistant"].content == "Drops grow until they fall."
    assert rows[1, 3, "user"].reply_to == 1 and rows[1, 3, "user"].root == 0 and rows[1, 3, "user"].content == "Thanks, clear."
    assert rows[1, 4, "assistant"].reply_to == 2 and rows[1, 5, "user"].root == 2
    assert rows[3, 2, "user"].reply_to == 1
    assert rows[2, 0, "user"].reply_to is None and rows[2, 0, "user"].content == "quoted from elsewhere"
    whole = {(r.conv_id, r.part): r for r in chats.chat_report(given).collect()}
    order = [whole[1, 0].chat.index(x) for x in ("How does", "Drops", "Thanks", "Another", "Scattering", "Oh.")]
    assert order == sorted(order) and ">" not in whole[1, 0].chat.replace("|>", "")
    assert {part for conv, part in whole if conv == 4} == {0}


def same_as_sql(given):
    db = duckdb.connect()
    conversations = given.toPandas()  # noqa: F841
    db.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(db.execute(chats.CHAT_SQL).fetchall(), key=key)
    assert sorted(map(tuple, chats.chat_report(given).collect()), key=key) == want


def test_same_as_sql(given):
    same_as_sql(given)


def test_hot_threads_are_cut(spark):
    """One thread that all quote, one turn of many texts, and one message a thousand times over."""
    rows = [(1, 0, "user", "The first words.")]
    rows += [(1, k, "user", f"> The first words.\nanswer {k}") for k in range(1, 1200)]
    rows += [(None, None, "user", f"text {k % 700}") for k in range(1100)]
    rows += [(2, 5, None, "the same again")] * 1003 + [(2, 6, "user", "> the same again\nenough")] * 2
    chat = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {(r.conv_id, r.part): r for r in chats.chat_report(chat).collect()}
    assert {k: r.n_messages for k, r in found.items()} == {
        (1, 0): 500, (1, 1): 500, (1, 2): 200, (None, 0): 500, (None, 1): 500, (None, 2): 100, (2, 0): 500, (2, 1): 500, (2, 2): 5,
    }
    assert sum(r.n_replies for (c, _), r in found.items() if c == 1) == 1199
    assert found[2, 2].n_replies == 2 and found[2, 2].chat.endswith("enough\n") and found[2, 2].chat.count("the same again") == 3
    same_as_sql(chat)


def test_native_and_empty(spark, given):
    from pyspark.sql import functions as F

    plan = chats.chat_report(given)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chats.chat_report(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = given.withColumns({c: F.lit(1) for c in ("c", "t", "own", "key", "level", "whole", "root", "parent")})
    assert chats.chat_report(clash).count() == chats.chat_report(given).count()
