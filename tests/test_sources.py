"""Source trees, index tables, streams and syntax-tree blocks on small fixtures."""

import datetime as dt

from siltstone.operators import code
from siltstone.sources import files, index
from siltstone.streaming import rollups

SOURCE = '''import os

@cache
def top(x):
    """Doc."""
    if x:
        return 1

class A:
    def m(self):
        def inner():
            pass
        for i in x:
            assert i
'''


def test_source_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PY").write_bytes(b"ok \xff end")
    (tmp_path / "a" / "skip_me.py").write_text("no")
    (tmp_path / "b.txt").write_text("no")
    got = files.source_files(spark, str(tmp_path), [".py"], ["skip_"], 1).collect()
    assert [(r.path.rsplit("/", 1)[1], r.size, r.text) for r in got] == [("x.PY", 8, "ok  end")]


def test_json_lines_and_resume(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    rows = files.json_lines(spark, str(tmp_path / "r.jsonl"), "id string")
    done = spark.createDataFrame([("a",), (None,)], "id string")
    assert [r.id for r in files.unprocessed(rows, done, "id").collect()] == ["b"]
    index.write_results(rows, str(tmp_path / "out"))
    index.write_results(rows, str(tmp_path / "out"), append=True)
    assert files.json_lines(spark, str(tmp_path / "out"), "id string").count() == 4


def test_index_round_trip(spark, tmp_path):
    rows = [(1, "fixed", "r1"), (2, "fixed", "r2"), (3, "sliding", "r1")]
    index.write_blocks(spark.createDataFrame(rows, "block_id int, strategy string, repo string"), str(tmp_path / "i"))
    index.write_blocks(spark.createDataFrame([(9, "fixed", "r2")], "block_id int, strategy string, repo string"), str(tmp_path / "i"))
    assert sorted(r.block_id for r in index.read_blocks(spark, str(tmp_path / "i")).collect()) == [1, 3, 9]
    assert [r.block_id for r in index.read_blocks(spark, str(tmp_path / "i"), "fixed", "r1").collect()] == [1]


def test_functions(spark):
    got = code.functions(spark.createDataFrame([("p.py", SOURCE), ("bad.py", "def ("), ("nul.py", "a\0"), ("none.py", None)], "path string, text string")).collect()
    assert [(r.qualified_name, r.class_name, r.start_line, r.end_line, r.complexity) for r in got] == [("top", None, 2, 6, 2), ("A::m", "A", 9, 13, 3), ("A::inner", "A", 10, 11, 1)]
    assert got[0].docstring == "Doc." and got[0].content.startswith("# p.py::top\n\n@cache\ndef top")


def test_stream_equals_table(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 20, at + dt.timedelta(minutes=7 * (i % 20)), "ab"[i % 2], float(i % 20)) for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rollups.windowed(rollups.first_seen(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="1 day"), late=None)
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    want = rollups.windowed(rollups.first_seen(events)).collect()
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, want))


def test_dense_top_is_the_top_of_dense(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from siltstone.operators import retrieval

    rng = np.random.default_rng(4)
    rows = [(i, np.round(x, 1).tolist()) for i, x in enumerate(rng.normal(size=(3000, 6)))]  # many ties
    rows += [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3002, [float("nan")] * 6), (3003, [1.0] * 5), (3004, [9.0, float("inf"), 1.0, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 250 = 0 or vec_id > 3000")
    want = retrieval.top(retrieval.dense(v, q).withColumn("score", F.round("score", 6)), 7)
    got = retrieval.dense_top(v, q, 7)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
