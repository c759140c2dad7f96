import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from supportgraph.operators.messages import new_turns
from supportgraph.schemas import SCHEMAS
from supportgraph.sources import conversations as logs
from supportgraph.sources import tables
from supportgraph.workspace import fresh_path


def test_schemas_and_counts(graph):
    counts = {label: df.count() for label, df in graph.tables().items()}
    assert counts == {
        "user": 3, "status": 3, "priority": 4, "category": 2, "ticket": 5, "comment": 12,
        "article": 2,
    }
    for label, df in graph.tables().items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in SCHEMAS[label]
        ]


def test_typing(graph):
    users = {r.userId: r.isActive for r in graph.user.collect()}
    assert users == {"u1": True, "u2": True, "u3": False}
    levels = {r.priorityId: r.level for r in graph.priority.collect()}
    assert levels == {"p1": 1, "p2": 2, "p3": None, "p4": None}
    tickets = {r.ticketId: r for r in graph.ticket.collect()}
    assert tickets["t1"].creationDate == dt.datetime(2024, 1, 1, 8)
    assert tickets["t5"].creationDate is None and tickets["t5"].resolvedDate is None
    assert tickets["t2"].assignedToUserId is None


def test_multi_line_and_quotes(graph):
    texts = {r.commentId: r.content for r in graph.comment.collect()}
    assert texts["m1"] == 'He said "hello"'
    assert texts["m2"] == "line one\nline two"


def test_rows_without_key(spark, csv_paths):
    rows = tables.read_csv(spark, csv_paths["user"])
    assert [r.username for r in tables.without_key(rows, "userId").collect()] == ["ghost"]


def test_missing_column_is_null(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("name,statusId\nOpen,s1\n")
    row = tables.load_node_table(spark, "status", str(path)).first()
    assert (row.statusId, row.name, row.isClosed) == ("s1", "Open", False)


def test_full_refresh(spark, graph, tmp_path):
    root = str(tmp_path / "graph")
    tables.refresh_graph(graph, root)
    tables.refresh_graph(graph, root)
    assert tables.read_graph(spark, root).comment.count() == 12


def test_vector_csv(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame(
        [("t1", 'a "b"\nc', [0.5, -1.0]), ("t2", None, [1e-9, 2.0])],
        "ticketId string, title string, embedding array<double>",
    )
    tables.write_csv_with_vectors(rows, path)
    back = {r.ticketId: r.embedding for r in tables.read_csv_vectors(spark, path).collect()}
    assert back == {"t1": [0.5, -1.0], "t2": [1e-9, 2.0]}


@pytest.fixture
def files(tmp_path):
    turns = [{"content": "Hé \"q\"", "role": "system"}, {"content": "two\nlines", "role": "user"}]
    (tmp_path / "2024-01-01 10.5.json").write_text(json.dumps(turns, indent=4))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "broken.json").write_text("[{")
    (tmp_path / "note.txt").write_text("[]")
    for age, name in enumerate(["broken.json", "empty.json", "2024-01-01 10.5.json"]):
        os.utime(tmp_path / name, (1_700_000_000 - age * 60,) * 2)
    return str(tmp_path)


def test_conversation_lists(spark, files, tmp_path):
    rows = logs.load_conversation_lists(spark, files, "*.json", skip_rejects=True).orderBy("turn").collect()
    assert [tuple(r) for r in rows] == [
        ("2024-01-01 10", 0, "system", 'Hé "q"'),
        ("2024-01-01 10", 1, "user", "two\nlines"),
    ]


def test_broken_conversation_lists(spark, files, tmp_path):
    with pytest.raises(Exception, match="broken.json: no list of messages"):
        logs.load_conversation_lists(spark, files).collect()
    (tmp_path / "blank.json").write_text(" ")
    (tmp_path / "role.json").write_text('[{"content": "x"}]')
    assert sorted(tuple(r) for r in logs.list_rejects(spark, files).collect()) == [
        ("blank.json", "empty"),
        ("broken.json", "no list of messages"),
        ("role.json", "message without role"),
    ]


LONG = [("hot", i, "user" if i % 2 else "assistant", f"{i}\n\"é\"") for i in range(60)]
# Ids that look like numbers, dates, paths or nothing, and the same number written differently.
NAMES = ["007", "7", "1.50", "1.5", "2024-01-01", "a b", "a+b", "a%20b", "x=y", "a/b", "a:b", "é", "NULL", "true", None]
NAMED = [(name, i, "user", f"{name} {i}") for name in NAMES for i in range(2)]


def split(spark, rows):
    """Few rows in several parts."""
    return spark.createDataFrame(rows, "conv_id string, turn int, role string, content string").repartition(3)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def several_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("form", ["files", "lists"])
def test_conversations_round_trip(spark, tmp_path, form, several_parts):
    path = str(tmp_path / form)
    write, load = {
        "files": (logs.write_conversation_files, logs.load_conversation_files),
        "lists": (logs.export_conversation_lists, logs.load_conversation_lists),
    }[form]
    short = [("a", 4, "user", "x\ny"), ("a", 9, "assistant", ""), ("b", 0, "user", 'q"'), ("wide", 7, "user", "é" * 600)]
    write(split(spark, [*LONG[::-1], *short, *NAMED]), path)
    wanted = [*LONG, ("a", 0, "user", "x\ny"), ("a", 1, "assistant", ""), short[2], ("wide", 0, "user", "é" * 600), *NAMED]
    assert as_set(load(spark, path)) == sorted(wanted, key=str)


def test_conversation_files_keep_an_empty_name(spark, tmp_path):
    rows = [("", 0, "user", "x"), (None, 0, "user", "y")]
    logs.write_conversation_files(split(spark, rows), str(tmp_path / "files"))
    assert as_set(logs.load_conversation_files(spark, str(tmp_path / "files"))) == sorted(rows, key=str)
    with pytest.raises(Exception, match="without a name"):
        logs.export_conversation_lists(split(spark, rows), str(tmp_path / "lists"))


def test_numbers_as_ids(spark, tmp_path):
    rows = spark.createDataFrame([(7, 0, "user", "x"), (10**15, 0, "user", "y")], "conv_id long, turn int, role string, content string")
    for i, (write, load) in enumerate([(logs.write_conversation_files, logs.load_conversation_files), (logs.export_conversation_lists, logs.load_conversation_lists)]):
        write(rows, str(tmp_path / str(i)))
        assert as_set(load(spark, str(tmp_path / str(i)))) == [(str(10**15), 0, "user", "y"), ("7", 0, "user", "x")]


def test_a_long_conversation_lies_in_several_files(spark, tmp_path, several_parts):
    path = str(tmp_path / "files")
    logs.write_conversation_files(split(spark, [*LONG, ("a", 0, "user", "x")]), path)
    texts = [p.read_text().splitlines() for p in (tmp_path / "files").glob("*.json")]
    assert len(texts) > 1 and sum('"hot"' in text[0] + text[-1] for text in texts) > 1
    listed = logs.list_conversation_files(spark, path).collect()
    assert len(listed) == len(texts) and {r.folder for r in listed} == {"files"}


def test_a_list_is_one_file_in_order(spark, tmp_path, several_parts):
    path, many = str(tmp_path / "lists"), [(f"c{i % 3}", i, "user", f"text {i}") for i in range(3000)]
    logs.export_conversation_lists(split(spark, many[::-1]), path)
    for conv in range(3):
        (file,) = (tmp_path / "lists" / f"conv_id=c{conv}").glob("*.txt")
        assert [m["content"] for m in json.loads(file.read_text())] == [f"text {i}" for i in range(conv, 3000, 3)]
    listed = logs.list_conversation_files(spark, path, pattern="*", recursive=True).collect()
    assert {r.folder for r in listed} == {"conv_id=c0", "conv_id=c1", "conv_id=c2"}


@pytest.mark.parametrize("form", ["files", "lists"])
def test_equal_turns_have_the_order_of_a_list(spark, tmp_path, form, several_parts):
    rows = [("c", turn, role, content) for turn in (None, 1) for content in ("y", "x") for role in ("v", "u")]
    path = str(tmp_path / form)
    if form == "files":
        logs.write_conversation_files(split(spark, rows * 2), path)
        back = logs.load_conversation_files(spark, path)
    else:
        logs.export_conversation_lists(split(spark, rows * 2), path)
        back = logs.load_conversation_lists(spark, path)
    wanted = [(content, role) for _ in (None, 1) for content in "xy" for role in "uv" for _ in range(2)]
    assert [(r.turn, r.content, r.role) for r in back.orderBy("turn").collect()] == [(i, *w) for i, w in enumerate(wanted)]


def test_broken_conversation_files(spark, tmp_path):
    other = [("good", i, "user", "x") for i in range(9)]
    path = str(tmp_path / "files")
    logs.write_conversation_files(split(spark, [*LONG, ("hot", 60, None, "x"), *other]), path)
    with pytest.raises(Exception, match="message without role"):
        logs.load_conversation_files(spark, path).collect()
    left = logs.load_conversation_files(spark, path, skip_rejects=True)
    assert as_set(left) == other
    assert [r.reason for r in logs.conversation_rejects(spark, path).collect()] == ["message without role"]
    (tmp_path / "files" / "part-x.json").write_text("no json\n")
    assert as_set(logs.load_conversation_files(spark, path, skip_rejects=True)) == other
    assert {r.reason for r in logs.conversation_rejects(spark, path).collect()} == {"message without role", "no message"}


def test_csv_keeps_white_space(spark, tmp_path):
    path = str(tmp_path / "csv")
    texts = ["  lead and trail  ", "tab\t", "\u00a0x\r\ny ", '"', ' "q" ', ",", "\\", None]
    rows = spark.createDataFrame([(f"t{i}", t, [1.0]) for i, t in enumerate(texts)], "ticketId string, title string, embedding array<double>")
    tables.write_csv_with_vectors(rows, path)
    back = {r.ticketId: r.title for r in tables.read_csv(spark, path).collect()}
    assert [back[f"t{i}"] for i in range(len(texts))] == texts


def test_rows_without_key_are_reported(spark, csv_paths):
    rejects = tables.load_rejects(spark, csv_paths).collect()
    assert [(r.label, r.key, r.reason) for r in rejects] == [("user", None, "no key")]
    assert json.loads(rejects[0].detail)["username"] == "ghost"


def test_file_listing(spark, files):
    rows = logs.list_conversation_files(spark, files).collect()
    assert [r.file_name for r in rows] == ["broken.json", "empty.json", "2024-01-01 10.5.json"]
    assert [r.label for r in rows] == ["broken", "empty", "2024-01-01 10"]
    assert rows[0].last_update == "2023-11-14 22:13:20"


def test_log_round_trip(spark):
    path = fresh_path(spark, "log")
    messages = spark.createDataFrame(
        [("a", 0, "user", "x\ny")], "conv_id string, turn int, role string, content string"
    )
    answers = spark.createDataFrame(
        [("a", "q", "r"), ("new", "q2", "r2")], "conv_id string, question string, answer string"
    )
    logs.append_conversations(messages, path)
    logs.append_conversations(new_turns(messages, answers, "be kind"), path)
    rows = logs.load_conversations(spark, path).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in rows] == [
        ("a", 0, "user", "x\ny"),
        ("a", 1, "system", "be kind"),
        ("a", 2, "user", "q"),
        ("a", 3, "assistant", "r"),
        ("new", 0, "system", "be kind"),
        ("new", 1, "user", "q2"),
        ("new", 2, "assistant", "r2"),
    ]


def test_shared_folder_comes_from_the_session(spark):
    assert fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.range(1).select(F.lit(1)).count() == 1
