import random
import time

import pytest

from supportgraph.streaming.conversations import STATE_STORE, prompt_stream
from supportgraph.workspace import fresh_path

SCHEMA = "conv_id string, turn long, role string, content string"


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.unset(STATE_STORE[0])


def conversation(name, n, seed):
    random.seed(seed)
    return [(name, i, random.choice(["user", "assistant", "user", "function", "system"]), f"{name} {i}") for i in range(n)]


def plain(rows, length, default):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted({r[:2]: r for r in rows if r[0] == conv}.values(), key=lambda r: r[1])
        for at, (_, turn, role, text) in enumerate(turns):
            if role != "user":
                continue
            own = [t[3] for t in turns[:at] if t[2] == "system"]
            before = [t for t in turns[max(0, at - length) : at] if t[2] in ("user", "assistant")]
            prompt = own[-1] if own else default
            head = [("system", prompt + "!")] if prompt else []
            out[conv, turn] = [*head, *[(t[2], t[3]) for t in before], ("user", text)]
    return out


def run(spark, batches, length, default="be kind", expire_ms=None, stop_after=None):
    """The prompts of a stream that gets one file of turns after the other, restarted for each."""
    source, checkpoint, out = (fresh_path(spark, n) for n in ("turns", "checkpoint", "prompts"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        turns = spark.readStream.schema(SCHEMA).parquet(source)
        stream = prompt_stream(turns, length, default, "!", expire_ms)
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        if expire_ms:
            time.sleep(expire_ms / 1000 + 0.2)
    found = {}
    for r in spark.read.parquet(out).collect():
        assert (r.conv_id, r.turn) not in found
        found[r.conv_id, r.turn] = [(m.role, m.content) for m in r.messages]
    return found


@pytest.mark.parametrize("length,default,cuts", [(3, "be kind", 1), (2, "", 4), (0, "x", 3)])
def test_prompts_do_not_depend_on_the_cut(spark, length, default, cuts):
    rows = [r for i in range(6) for r in conversation(f"c{i}", 12, i)]
    batches = [[r for r in rows if r[1] * cuts // 12 == part] for part in range(cuts)]
    assert run(spark, batches, length, default) == plain(rows, length, default)


def test_repeated_turns_are_dropped(spark):
    rows = conversation("a", 8, 3)
    assert run(spark, [rows[:5] + rows[:2], rows[2:]], 3) == plain(rows, 3, "be kind")


def test_expired_conversations_begin_anew(spark):
    rows = [("a", i, "user", f"q{i}") for i in range(3)]
    found = run(spark, [rows[:1], [("b", 0, "user", "other")], rows[1:]], 3, expire_ms=300)
    assert found["a", 1] == [("system", "be kind!"), ("user", "q1")]
    assert found["a", 2] == [("system", "be kind!"), ("user", "q1"), ("user", "q2")]


def test_rows_without_a_conversation_are_left_out(spark):
    rows = [(None, 0, "user", "x"), ("a", None, "user", "y"), ("a", 1, "user", None)]
    assert run(spark, [rows], 2) == {("a", 1): [("system", "be kind!"), ("user", None)]}
