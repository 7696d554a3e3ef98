"""Sources and sinks on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscope.sources import readers, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_bytes("é\xff".encode("latin-1") + "ok".encode())
    (tmp_path / "a" / "b" / "two.bin").write_bytes(b"x" * 8000 + b"\x00")
    (tmp_path / "three.txt").write_bytes(b"y" * 8192 + b"\x00")
    rows = readers.read_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.path.rsplit("/", 1)[1], r.is_binary) for r in rows] == [("two.bin", True), ("one.txt", False), ("three.txt", False)]
    assert rows[1].text == "��ok"


def test_tasks(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"task_id": "a"}, {"task_id": "b"}]')
    schema = "task_id string"
    assert sorted(r.task_id for r in readers.read_tasks(spark, str(tmp_path), schema, strict=True).collect()) == ["a", "b"]
    (tmp_path / "more.json").write_text('[{"task_id": "a"}, {"x": 1}]')
    with pytest.raises(ValueError):
        readers.read_tasks(spark, str(tmp_path), schema, strict=True)
    (tmp_path / "bad.json").write_text("[{")
    assert readers.read_tasks(spark, str(tmp_path), schema).where("task_id is not null").count() == 3


def test_guarded_sql(spark):
    assert readers.passed_through(spark, " SELECT 1 AS x, 'a' AS y") == {"columns": ["x", "y"], "rows": [(1, "a")], "error": None}
    assert "SELECT" in readers.passed_through(spark, "WITH a AS (SELECT 1) SELECT * FROM a")["error"]
    assert readers.passed_through(spark, "select no_such_column")["error"]
    assert readers.probe(spark)["healthy"]
    slow = readers.passed_through(spark, "SELECT count(*) AS n FROM range(40000000) a JOIN range(4000000) b ON a.id % 1000 = b.id % 1000", seconds=1.0)
    assert slow["rows"] == [] and slow["error"]


def test_jdbc(spark):
    url, driver = "jdbc:derby:memory:corpus;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark.range(100).selectExpr("id", "id * 2 AS twice").write.mode("overwrite").jdbc(url, "numbers", properties=driver)
    except Exception as error:  # noqa: BLE001
        pytest.skip(f"no embedded database: {error}"[:200])
    rows = readers.read_jdbc(spark, url, "numbers", driver, "id", 0, 100, 4)
    assert rows.rdd.getNumPartitions() == 4 and rows.agg(F.sum("twice")).first()[0] == 9900
    assert readers.read_jdbc(spark, url, "numbers", driver).count() == 100


def test_batches(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else 1) for i in range(2000)], "id long, tokens int")
    first = [r.id for r in readers.next_batch(rows, "id", -1, "tokens").collect()]
    assert len(first) == 500 and first == sorted(first) and all(i % 3 for i in first)
    assert readers.next_batch(rows, "id", first[-1], "tokens").first().id > first[-1]


def test_sinks_that_fail(spark, tmp_path):
    def broken(df):
        raise OSError("gone")

    df = spark.range(3)
    assert sinks.best_effort(broken)(df) is False
    assert sinks.best_effort(lambda d: sinks.write_parquet(d, str(tmp_path / "p"), single=True))(df) is True
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_document(spark, tmp_path):
    sinks.write_document(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "d"))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "d")).first().b == [1, 2]
    assert "\n" in next((tmp_path / "d").glob("part*")).read_text().strip()
