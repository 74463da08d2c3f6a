import random

import pytest

from gatherum.sources import readers, records


def _written(folder, rows, newline="\n"):
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    body = newline.join(["Label,Other,Text", *[f"{n},x,{quoted(t)}" for n, t in rows]]) + newline
    folder.write_bytes(body.encode())


def _ranged(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: _ranged(spark, size)
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size, newline", [(23, "\n"), (64, "\r\n"), (1 << 20, "\n")])
def test_records_cross_every_range_border(spark, tmp_path, small_ranges, size, newline):
    draw = random.Random(size)
    rows = [(i % 5, "".join(draw.choice(['"', "\n", ",", "é", "a", "b ", "\n\n"]) for _ in range(draw.randrange(1, 60)))) for i in range(30)]
    rows.append((3, "long\n" * 60 + '"'))
    path = tmp_path / "c.csv"
    _written(path, rows, newline)
    small_ranges(size)
    got = readers.read_labelled_csv(spark, str(path)).orderBy("id").collect()
    assert [(r["label"], r["document"]) for r in got] == rows
    small_ranges(1 << 27)
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)).select("Label", "Text").collect()
    assert [(int(r[0]), r[1]) for r in plain] == rows


def test_bad_rows_are_errors(spark, tmp_path):
    path = tmp_path / "c.csv"
    for body in ('Text,Label\n"a",many\n', 'Text,Label\n"a",1,2\n', 'Text,Label\n"a,1\n'):
        path.write_text(body)
        with pytest.raises(Exception, match="(?i)malformed|does not end"):
            readers.read_labelled_csv(spark, str(path)).collect()
    path.write_text("Words,Label\na,1\n")
    with pytest.raises(ValueError):
        readers.read_labelled_csv(spark, str(path))
    path.write_text('Text,Label\n\n"",\n')
    assert [(r["document"], r["label"]) for r in readers.read_labelled_csv(spark, str(path)).collect()] == [(None, None)]
    path.write_text("")
    assert readers.read_labelled_csv(spark, str(path)).count() == 0


def test_files_share_one_header(spark, tmp_path):
    for name, head in (("a", "Text,Label"), ("b", "Label,Text")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n1,1\n")
    with pytest.raises(ValueError):
        records.read_csv(spark, str(tmp_path), {"Text": None})
