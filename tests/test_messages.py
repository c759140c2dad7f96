import pytest

from supportgraph.operators import messages as talk

SCHEMA = "conv_id string, turn int, role string, content string"


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [
            ("a", 0, "system", "old"), ("a", 1, "user", "one"), ("a", 2, "tool", "rows"),
            ("a", 3, "system", "newer"), ("a", 4, "function", ""), ("a", 5, "function", "shown"),
            ("b", 0, "user", "hi"), ("b", 1, "assistant", None),
        ],
        SCHEMA,
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cut_comes_before_the_role_filter(log):
    got = rows(talk.history_window(log, 3))
    assert got == [("a", 3, "system", "newer"), ("b", 0, "user", "hi"), ("b", 1, "assistant", None)]
    assert talk.history_window(log, 0).count() == 0
    assert talk.history_window(log, 99).count() == 5


def test_display(log):
    shown = rows(talk.for_display(log))
    assert [(r[0], r[1]) for r in shown] == [("a", 1), ("a", 5), ("b", 0), ("b", 1)]


def test_prompts(spark, log):
    questions = spark.createDataFrame(
        [("a", 1, "why?"), ("a", 2, "how?"), ("new", 1, "who?")],
        "conv_id string, question_id int, question string",
    )
    got = {
        (r.conv_id, r.question_id): [(m.role, m.content) for m in r.messages]
        for r in talk.prompt_table(log, questions, 3, "Be kind.", " Search.").collect()
    }
    assert got == {
        ("a", 1): [("system", "Be kind. Search."), ("system", "newer"), ("user", "why?")],
        ("a", 2): [("system", "Be kind. Search."), ("system", "newer"), ("user", "how?")],
        ("new", 1): [("system", "Be kind. Search."), ("user", "who?")],
    }
    bare = talk.prompt_table(log, questions, 0, "").where("conv_id = 'new'").first()
    assert [tuple(m) for m in bare.messages] == [("user", "who?")]


def test_stats_and_recovery(log):
    assert rows(talk.conversation_stats(log)) == [("a", 5, True), ("b", 1, False)]
    assert rows(talk.last_system_message(log)) == [("a", "newer")]
    assert rows(talk.recovered_system_prompt(log, "std")) == [("a", "newer"), ("b", "std")]


def test_upsert(log):
    got = rows(talk.upsert_system_prompt(log, "now"))
    assert [r for r in got if r[2] == "system"] == [
        ("a", 0, "system", "now"), ("a", 3, "system", "now"), ("b", 2, "system", "now"),
    ]
    assert len(got) == 9
    again = talk.upsert_system_prompt(talk.upsert_system_prompt(log, "x"), "now")
    assert rows(again) == got


def test_append(spark, log):
    answers = spark.createDataFrame(
        [("a", "q", "r"), ("b", "q", "r"), ("c", "q", "r")],
        "conv_id string, question string, answer string",
    )
    added = rows(talk.new_turns(log, answers, "sys"))
    assert added == [
        ("a", 6, "user", "q"), ("a", 7, "assistant", "r"),
        ("b", 2, "system", "sys"), ("b", 3, "user", "q"), ("b", 4, "assistant", "r"),
        ("c", 0, "system", "sys"), ("c", 1, "user", "q"), ("c", 2, "assistant", "r"),
    ]
    assert talk.append_turns(log, answers, "sys").count() == 16
    several = spark.createDataFrame(
        [("b", "q2", "r2", 2), ("b", "q1", "r1", 1), ("c", "q", "r", 1), ("b", "q1", "r1", 1), (None, "q", "r", 1)],
        "conv_id string, question string, answer string, at int",
    )
    added = rows(talk.new_turns(log, several, "sys", "at").where("conv_id = 'b'"))
    assert added == [
        ("b", 2, "system", "sys"), ("b", 3, "user", "q1"), ("b", 4, "assistant", "r1"),
        ("b", 5, "user", "q1"), ("b", 6, "assistant", "r1"),
        ("b", 7, "user", "q2"), ("b", 8, "assistant", "r2"),
    ]
    assert talk.new_turns(log, several, "sys", "at").count() == 13
    assert [r[1] for r in rows(talk.new_turns(log, several.where("conv_id = 'a'"), "", "at"))] == []
    assert len(rows(talk.new_turns(log, answers))) == 6
