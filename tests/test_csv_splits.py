import os

import pytest
from pyspark.sql import functions as F

from sparkpanel import jobs
from sparkpanel.sources import csv_split, io


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def quoted_file(folder, name="q.csv", end="\n"):
    lines = ["id;note;n"]
    for i in range(400):
        note = {0: f'"line one{end}line two {i}"', 1: f'"a ""quoted"" word; {i}"', 2: f"plain {i}", 3: "", 4: '""',
                5: f'"{end}{end}starts and ends with breaks{end}"', 6: '"' + f"long {i} {end}" * 40 + '"', 7: "é日本"}[i % 8]
        lines.append(f"{i};{note};{i * 7}")
    return write(os.path.join(folder, name), end.join(lines) + end)


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("size", [200, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_breaks_in_splits_equal_the_one_task_read(spark, small_splits, tmpdir_path, size, end):
    path = quoted_file(tmpdir_path, end=end)
    whole = io.read_csv_strings(spark, path, multi_line=True).cache()
    assert whole.count() == 400
    small_splits(size)
    split = io.read_csv_strings(spark, path)
    assert same(split, whole)
    if size == 200:
        assert csv_split.split_states(csv_split.physical_lines(spark, path)).filter("inside").count() > 5


def test_more_than_one_task_and_several_files(spark, small_splits, tmpdir_path):
    folder = os.path.join(tmpdir_path, "many")
    os.makedirs(folder)
    for i in range(3):
        quoted_file(folder, f"{i}.csv")
    whole = io.read_csv_strings(spark, folder, multi_line=True).cache()
    assert whole.count() == 1200
    small_splits(4096)
    lines = csv_split.physical_lines(spark, folder)
    assert lines.rdd.getNumPartitions() > 3
    assert same(io.read_csv_strings(spark, folder), whole)


@pytest.mark.parametrize("text", [
    'a;b\n1;5" pipe\n2;x\n', 'a;b\n1;"x" y\n2;z\n', 'a;b\n', "a;b\n1;2", 'a;b\n\n1;2\n\n', 'a;b\n1;2;3\n4\n', 'a;b\n1;"x;y"\n',
    'a;b\n1; "x"\n', '"a\nb";c\n1;2\n', 'a;b\n1;" padded "\n'])
def test_odd_files_equal_the_one_task_read(spark, small_splits, tmpdir_path, text):
    path = write(os.path.join(tmpdir_path, "odd.csv"), text)
    whole = io.read_csv_strings(spark, path, multi_line=True).cache()
    whole.count()
    small_splits(5)
    assert same(io.read_csv_strings(spark, path), whole)


@pytest.mark.parametrize("text,good", [("1;2", True), ('"a;b";"c ""d"""', True), ('5" pipe;x', False), ('"x" y;z', False),
                                       ('"open;x', False), ('"a\nb";', True), ('', True)])
def test_well_formed(spark, text, good):
    assert spark.createDataFrame([(text,)], "t string").select(csv_split.well_formed(F.col("t"), ";")).first()[0] is good


def test_files_without_quoted_breaks_are_read_in_splits(spark, small_splits, tmpdir_path):
    path = write(os.path.join(tmpdir_path, "t.csv"), "a,b\n" + "".join(f"{i},x{i}\n" for i in range(20_000)))
    small_splits(32 * 1024)
    whole, split = io.read_table(spark, path, multi_line=True), io.read_table(spark, path, multi_line=False)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 1
    assert split.schema == whole.schema and split.count() == 20_000 and same(split, whole)
    default = io.read_table(spark, path)
    assert default.schema == whole.schema and default.rdd.getNumPartitions() > 1 and same(default, whole)


def test_jobs_pass_it_on(spark, monkeypatch):
    asked = []

    def reader(*args, **kw):
        asked.append(kw.get("multi_line"))
        raise KeyError

    monkeypatch.setattr(io, "read_csv_strings", reader)
    for call in (lambda: jobs.build_dataset(spark, {2020: "x.csv"}, "out", multi_line=False),
                 lambda: jobs.drift_job(spark, "a.csv", "b.csv", "out", multi_line=False),
                 lambda: io.read_first_available(spark, "/nowhere", "t", multi_line=False),
                 lambda: io.load_periods(spark, {2020: "a.csv"}, multi_line=False),
                 lambda: io.load_train_test(spark, "a.csv", "b.csv", multi_line=False)):
        with pytest.raises(KeyError):
            call()
    assert asked == [False] * 5
