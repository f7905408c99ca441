"""Files that are there whole or not at all; tails that are put together from their own lines only."""

import os
import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import contexts, views
from runloom.sources import sinks


def shown(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("_"))


def read(folder, name):
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        return f.read()


def test_pages_are_written_by_tasks_and_replaced_by_name(spark, tmp_path):
    folder = str(tmp_path / "p")
    rows = spark.range(30).select(F.concat(F.lit("s"), "id", F.lit(".html")).alias("name"), F.concat(F.lit("é "), "id").alias("content")).repartition(5)
    sinks.write_committed(rows, folder)
    sinks.write_committed(rows.limit(1).withColumn("name", F.lit("s3.html")).withColumn("content", F.lit("new")), folder)
    assert len(shown(folder)) == 30 and read(folder, "s7.html") == "é 7" and read(folder, "s3.html") == "new"
    assert os.listdir(os.path.join(folder, sinks.STAGING)) == []
    sinks.write_committed(rows.where("name = 's1.html'"), folder, mode="overwrite")
    assert shown(folder) == ["s1.html"]


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    folder = str(tmp_path / "p")
    bad = F.when(F.col("id") == 29, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.lit("x"))
    rows = spark.range(0, 30, 1, 4).select(F.concat(F.lit("s"), "id").alias("name"), bad.alias("content"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_committed(rows, folder)
    assert shown(folder) == [] and os.listdir(os.path.join(folder, sinks.STAGING)) == []
    with pytest.raises(Exception, match="one name"):
        sinks.write_committed(spark.range(2).select(F.lit("a").alias("name"), F.lit("").alias("content")), folder)
    with pytest.raises(Exception, match="no name of a page"):
        sinks.write_committed(spark.range(1).select(F.lit("../a").alias("name"), F.lit("").alias("content")), folder)
    assert shown(folder) == []


def test_lines_of_any_number(spark, tmp_path):
    folder = str(tmp_path / "l")
    for a, b in ((0, 1000), (1000, 1500)):
        sinks.write_committed(spark.range(a, b, 1, 4).select(F.to_json(F.struct("id")).alias("value")), folder, kind="lines")
    assert spark.read.json(folder).count() == 1500 and len(shown(folder)) == 8


def test_a_batch_that_is_tried_again_is_written_once(tmp_path):
    folder = str(tmp_path / "s")

    def attempt(values, crash=None):
        w = sinks._StreamWriter({"path": folder, "kind": "lines"})
        messages = [w.write(iter([(v,)])) for v in values]
        if crash:
            move, n = w._move, []
            w._move = lambda moves: [move([m]) if len(n) < crash and not n.append(1) else (_ for _ in ()).throw(OSError("crash")) for m in moves]
        w.commit(messages, 7)

    with pytest.raises(OSError, match="crash"):
        attempt(["a", "b", "c"], crash=2)
    attempt(["a b", "c"])
    attempt(["a b", "c"])
    assert [read(folder, n) for n in shown(folder)] == ["a b\n", "c\n"]


def test_a_stream_writes_pages(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.dataSource.register(sinks.CommittedSink)
    for i in range(2):
        spark.range(i * 3, i * 3 + 3).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("string").alias("content")).write.mode("append").parquet(src)
        stream = spark.readStream.schema("name string, content string").parquet(src)
        stream.writeStream.format("committed").option("path", folder).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert shown(folder) == [f"n{i}" for i in range(6)] and len(os.listdir(os.path.join(folder, sinks.LOG))) == 2


@pytest.mark.parametrize("most", [1, 7, 40, 100_000])
@pytest.mark.parametrize("size", [None, 3])
def test_tails_are_those_of_the_whole(spark, most, size):
    rng = random.Random(most)
    rows = [(p, i, rng.choice([None, "", "é" * rng.randrange(20), "ab\ncd", "x"])) for p in "abc" for i in range(rng.randrange(1, 25))]
    got = {r["path"]: r["context"] for r in contexts.tail(spark.createDataFrame(rows, "path string, n long, t string").repartition(3), "n", "t", most, size).collect()}
    for p in "abc":
        whole = "\n".join(t or "" for q, _, t in sorted(rows, key=lambda r: r[1]) if q == p)
        assert got.get(p, "") == whole[-most:]


def test_page_names(spark):
    got = spark.createDataFrame([("/x/-home-me-proj/ab.c.jsonl",), ("one.jsonl",), ("/y/user=3/a b.jsonl",)], "p string").select(views.page_name(F.col("p")).alias("n")).collect()
    assert [r["n"] for r in got] == ["-home-me-proj__ab.c.html", "one.html", "user=3__a-b.html"]


def test_lines_of_a_name_make_one_file(spark, tmp_path):
    """As transcripts of many users are written; a name in two places is an error, and leaves nothing."""
    folder = str(tmp_path / "n")
    rows = spark.range(600).select(F.concat(F.lit("u"), F.col("id") % 40, F.lit(".jsonl")).alias("name"), F.col("id").cast("string").alias("value"))
    with pytest.raises(Exception, match="one name"):
        sinks.write_committed(rows.coalesce(1), folder, kind="named")
    assert shown(folder) == []
    sinks.write_committed(rows.repartition(7, "name").sortWithinPartitions("name", F.col("value").cast("int")), folder, kind="named")
    assert len(shown(folder)) == 40 and read(folder, "u3.jsonl") == "".join(f"{i}\n" for i in range(3, 600, 40))


def test_pages_come_to_python_in_small_batches(spark):
    """A worker holds the rows of a batch: with Spark's 10,000 states or pages at once it takes gigabytes."""
    from runloom.operators.fold import fold
    from runloom.sources.adapters import canonical

    rows = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.lit("user").alias("source"), F.struct(F.lit("ask").alias("text")).alias("p"))
    payload = F.struct(F.col("p.text").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("truncated", "boolean"), ("sha256", "string"), ("char_len", "long"), ("tool_name", "string"), ("tool_input_preview", "string"), ("is_error", "boolean"))])
    made = views.pages(fold(canonical(rows.withColumn("payload", payload)))).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.num_rows]})

    found = [r["n"] for r in made.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 3000 and max(found) <= 512


def test_files_are_handed_over_in_groups_and_all_are_moved(tmp_path, monkeypatch):
    handed = []

    class Movers(sinks.ThreadPoolExecutor):
        def map(self, f, parts):
            handed.extend(parts)
            return super().map(f, handed)

    monkeypatch.setattr(sinks, "ThreadPoolExecutor", Movers)
    w, folder = sinks._BatchWriter({"path": str(tmp_path / "p")}), str(tmp_path / "p")
    w.commit([w.write(iter([{"name": f"n{i}", "content": str(i)} for i in range(j, 5000, 3)])) for j in range(3)])
    assert len(shown(folder)) == 5000 and read(folder, "n4321") == "4321" and os.listdir(os.path.join(folder, sinks.STAGING)) == []
    assert len(handed) == -(-5000 // sinks.HANDED)
