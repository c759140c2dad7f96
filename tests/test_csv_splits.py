import csv
import io
import random

import pytest

from supportgraph.sources.csv_splits import FIELDS, OPEN_QUOTE, STRAY_QUOTE, csv_split_rejects, read_csv_splits
from supportgraph.sources.tables import read_csv

TEXTS = ["plain", "two\nlines", 'say "hi"', "a,b", "\n\n\n", '"', '""\n"', "é\n日本", " blanks ", "", "x" * 90, 'end"\n', "\r\nwin"]


@pytest.fixture
def small_splits(spark):
    """Call a reader while files are cut into splits of so many bytes. It scans the file right away;
    what it has stored is read in splits of the usual size."""

    def read(size, reader, path):
        settings = {"maxPartitionBytes": size, "openCostInBytes": 0, "minPartitionNum": 1}
        for name, value in settings.items():
            spark.conf.set(f"spark.sql.files.{name}", str(value))
        try:
            return reader(spark, str(path))
        finally:
            for name in settings:
                spark.conf.unset(f"spark.sql.files.{name}")

    return read


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(["id", "text", "note"])
        writer.writerows(rows)


def rows_of(n):
    random.seed(n)
    return [(str(i), random.choice(TEXTS), random.choice(TEXTS)) for i in range(n)]


def found(df):
    return sorted(tuple(x or "" for x in r) for r in df.collect())


@pytest.mark.parametrize("size", [23, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_cut(spark, tmp_path, small_splits, size, end):
    rows, more = rows_of(24), [(f"m{i}", a, b) for i, a, b in rows_of(8)]
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", rows, end)
    write(tmp_path / "in" / "b.csv", more, end)
    path = tmp_path / "in"
    out = small_splits(size, read_csv_splits, path)
    assert out.columns == ["id", "text", "note"]
    assert found(out) == sorted([*rows, *more])
    assert small_splits(size, csv_split_rejects, path).collect() == []
    if size == 23:
        assert small_splits(size, lambda s, p: s.read.text(p).rdd.getNumPartitions(), path) > 20


def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_splits):
    rows = [r for r in rows_of(60) if "\r" not in r[1] + r[2]]
    write(tmp_path / "a.csv", rows)
    assert found(small_splits(150, read_csv_splits, tmp_path)) == found(read_csv(spark, str(tmp_path)))


def test_a_field_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line "{i}", more' for i in range(60))
    write(tmp_path / "a.csv", [("1", long, "x"), ("2", "y", "z")])
    assert found(small_splits(64, read_csv_splits, tmp_path)) == [("1", long, "x"), ("2", "y", "z")]


def test_broken_records_are_reported(spark, tmp_path, small_splits):
    text = 'id,text,note\n1,a,b\n2,only\n3,a,b,c\n4,5" pipe and 6" pipe,x\n\n5,ok,"fine"\n6,"never closed,x\n7,y,z\n'
    (tmp_path / "a.csv").write_text(text)
    rejects = sorted((r.reason, r.fields[0]) for r in small_splits(20, csv_split_rejects, tmp_path).collect())
    assert rejects == sorted([(FIELDS, "2"), (FIELDS, "3"), (STRAY_QUOTE, "4"), (OPEN_QUOTE, '6,"never closed,x\n7,y,z')])
    assert found(small_splits(20, read_csv_splits, tmp_path)) == [
        ("1", "a", "b"), ("2", "only", ""), ("3", "a", "b"), ("4", '5" pipe and 6" pipe', "x"), ("5", "ok", "fine"),
    ]


def test_quotes_are_counted_like_a_parser():
    from supportgraph.sources.csv_splits import _quoted

    random.seed(3)
    for _ in range(300):
        row = [random.choice(TEXTS) for _ in range(3)]
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(row)
        assert _quoted(out.getvalue()) == 3
