from __future__ import annotations

import json
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter import schemas
from tiltmeter.operators import catalog as C
from tiltmeter.plans import fixtures as X
from tiltmeter.sources import corpora, tables
from tiltmeter.streaming import live

PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.read_if_there(spark, str(tmp_path / "none"), PAIR).count() == 0


def test_runs_are_partitioned(spark, sf_dir, tmp_path):
    path = str(tmp_path / "runs")
    answers = X.responses(spark, sf_dir, methods=("rtn_w4",), conditions=("plain",))
    tables.write_runs(answers, path)
    back = spark.read.parquet(path).where("data_seed = 2 and method_id = 'rtn_w4'")
    assert back.count() == answers.where("data_seed = 2").count()
    assert "PartitionFilters: [isnotnull(data_seed" in back._jdf.queryExecution().toString()
    listed = C.files(spark, path).withColumn("stem", C.stem(F.col("path")))
    assert listed.count() > 0 and listed.where("stem like 'part-%'").count() > 0


def test_states_spill_to_a_side_table(spark, tmp_path):
    path = str(tmp_path / "states")
    df = spark.createDataFrame(
        [(1, 7, {"layer_0": [1.0, 2.0]}), (2, 7, {})], "row_idx long, data_seed long, layer_hidden_states map<string,array<float>>"
    )
    slim = tables.write_states(df, path)
    assert slim.columns == ["row_idx", "data_seed"]
    back = {r["row_idx"]: r["layer_hidden_states"] for r in tables.with_states(slim, spark, path).collect()}
    assert back == {1: {"layer_0": [1.0, 2.0]}, 2: None}


def test_text_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,\"y\""), (2, None)], PAIR)
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "j"), PAIR).collect())) == [(1, 'x,"y"'), (2, None)]
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), PAIR).count() == 2


def test_subsets_stand_in_for_the_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], PAIR)
    for name in ("s1", "s2"):
        df.write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / n) for n in ("s1", "s2", "s3")]
    assert corpora.read_subsets(spark, str(tmp_path / "all"), paths).count() == 2
    df.write.parquet(str(tmp_path / "all"))
    assert corpora.read_subsets(spark, str(tmp_path / "all"), paths).count() == 1
    with pytest.raises(FileNotFoundError):
        corpora.read_subsets(spark, str(tmp_path / "no"), [str(tmp_path / "never")])


def test_row_index_is_dense_and_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(7).write.parquet(path)
    rows = corpora.with_row_index(spark, path).collect()
    assert sorted(r["row_idx"] for r in rows) == list(range(1000))
    again = {r["row_idx"]: r["text"] for r in corpora.with_row_index(spark, path).repartition(3).collect()}
    assert all(again[r["row_idx"]] == r["text"] for r in rows)
    assert corpora.calibration_texts(spark, "c4", path).columns == ["doc_id", "text"]
    spark.read.parquet(path).write.json(str(tmp_path / "t.jsonl"))
    with pytest.raises(schemas.MissingColumns):
        corpora.calibration_texts(spark, "c4", str(tmp_path / "t.jsonl"))


def test_custom_samples_file(spark, tmp_path):
    (tmp_path / "samples.json").write_text(json.dumps([{"question": "q", "image": ["a.png", "/b.png"]}, {"answer": "x"}]))
    rows = corpora.read_custom_samples(spark, str(tmp_path)).orderBy("question").collect()
    assert rows[1]["image"] == [f"{tmp_path}/a.png", "/b.png"] and rows[1]["answer"] == ""
    assert rows[0]["question"] == "" and rows[0]["image"] is None and rows[0]["audio"] is None


def test_spilling_stream_survives_a_restart(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).selectExpr("id", "id % 2 as data_seed").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, data_seed long").parquet(source)
        live.spill(stream, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 20


def test_moving_range_over_two_runs(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    values = [(b, [float(b % 5), float(b)]) for b in range(20)]
    low = high = None
    for part in (values[:10], values[10:]):
        spark.createDataFrame([("k", *v) for v in part], "input string, batch long, x array<double>").write.mode("append").parquet(source)
        stream = spark.readStream.schema("input string, batch long, x array<double>").parquet(source)
        got = live.moving_range_table(live.batch_ranges_of(stream, ["input"], "batch"), ["input"], 0.2, state).first()
        for _, x in part:
            low = min(x) if low is None else low + 0.2 * (min(x) - low)
            high = max(x) if high is None else high + 0.2 * (max(x) - high)
        assert (got["low"], got["high"]) == pytest.approx((low, high))


def test_running_gram_goes_on_after_a_restart(spark, tmp_path):
    """Several micro-batches, a restart, a matrix that does not change again, a NULL key: as the batch operator."""
    from tiltmeter.operators.gram import gram

    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    parts = [[("a", [1.0, 2.0]), (None, [0.5, 0.0])], [("a", [3.0, -1.0])], [("b", [2.0, 2.0]), ("a", [0.0, 1.0])]]
    for upto in range(1, len(parts) + 1):
        spark.createDataFrame(parts[upto - 1], "m string, x array<double>").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("m string, x array<double>").option("maxFilesPerTrigger", 1).parquet(source)
        got = {(r.m, r.i): r.h for r in live.running_gram(stream, folder, keys=["m"]).collect()}
        want = {(r.m, r.i): r.h for r in gram(spark.createDataFrame([r for p in parts[:upto] for r in p], "m string, x array<double>"), keys=["m"]).collect()}
        assert got == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0
