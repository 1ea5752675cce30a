import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import agreement
from corpusloom.sources import files, sinks
from corpusloom.sources.tables import table
from corpusloom.streaming import units as stream


def test_jsonl_tempers(spark, tmp_path):
    good = {"text": "a", "label": ["x"], "meta": {"doc_id": 1, "sentence_id": 2, "language": "EN"}}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n{broken\n")
    p = str(tmp_path / "a.jsonl")
    assert files.jsonl(spark, p).count() == 2 and files.jsonl(spark, p, malformed="skip").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl(spark, p, malformed="fail").collect()
    assert files.jsonl(spark, p, malformed="skip").select("meta.doc_id").first()[0] == 1


def test_label_list_and_pairs(spark, tmp_path):
    (tmp_path / "l.json").write_text('["b", "a"]')
    assert [tuple(r) for r in files.label_list(spark, str(tmp_path / "l.json")).orderBy("position").collect()] == [("b", 0), ("a", 1)]
    names = spark.createDataFrame([("x_train_EN.jsonl",), ("x_validation_EN.jsonl",), ("y_train_FR.jsonl",)], "name string")
    assert [r[0] for r in files.paired_files(spark, names).collect()] == ["x_train_EN.jsonl"]


def test_training_logs(spark, tmp_path):
    for d in ("Cult_1_EN", "Cult_1_FR"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "log.csv").write_text("epoch,train_loss\n1,0.5\n2,0.4\n")
    got = files.training_logs(spark, str(tmp_path / "*" / "log.csv"), "epoch int, train_loss double")
    assert sorted((r["category"], r["language"], r["epoch"]) for r in got.collect()) == [("Cult_1", l, e) for l in ("EN", "FR") for e in (1, 2)]


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.12345, None), ("a", None, 2)], "k string, x double, n int")
    sinks.report_csv(df, str(tmp_path / "r"), ["k", "x", "n"], ["k"])
    text = next((tmp_path / "r").glob("*.csv")).read_text()
    assert text == "k,x,n\na,--,2\nb,0.123,--\n"
    assert files.csv(spark, str(tmp_path / "r"), "k string, x string, n string", ["k", "n", "absent"]).columns == ["k", "n"]
    sinks.appended_csv(df, str(tmp_path / "log"))
    sinks.appended_csv(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 4


def test_json_and_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([("été", 1, 0, None), ("x", None, 1, 5)], "t string, a int, b int, d int")
    recs = sinks.annotation_records(df.withColumn("media", F.lit(None).cast("string")), ["a", "b"], "t", ["media", "d"])
    sinks.jsonl(recs, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert {(x["text"], tuple(x["label"]), x["meta"]["media"]) for x in lines} == {("été", ("a",), "media : not provided"), ("x", ("b",), "media : not provided")}
    sinks.parquet(df, str(tmp_path / "t.parquet"), ["b"])
    assert table(spark, str(tmp_path), "t").filter("b = 1").count() == 1


def test_table_if_absent(spark, tmp_path):
    spark.sql("drop table if exists once_only")
    for k in (1, 2):
        sinks.table_if_absent(spark.range(k), "once_only")
    assert spark.table("once_only").count() == 1
    spark.sql("drop table once_only")


def test_stream_resumes(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    src = str(tmp_path / "in")
    add = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(src)
    add([(1, "One. Two.", "2024-01-01 00:00:00"), (1, "One. Two.", "2024-01-01 01:00:00"), (None, "x", "2024-01-01 00:00:00")])
    run = lambda: stream.written(stream.unit_stream(spark.readStream.schema(schema).parquet(src), "doc_id", "text", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    add([(2, "The cost. More.", "2024-01-02 00:00:00")])
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 4 and out.filter("doc_id = 2 and sentence_id = 1").first()["economic_frame"] == 1
    batch = stream.unit_stream(spark.read.schema(schema).parquet(src), "doc_id", "text", "ts")
    assert batch.count() == 4 and stream.windowed_counts(batch, "ts", "economic_frame").count() == 2


def test_malformed_line_is_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "label": []}\n\n{"text": broken\n')
    (tmp_path / "b.jsonl").write_text('{"text": "x", "label": []}\n\n{"text": "y", "label": ["e"]}\n')
    assert sorted(r["text"] for r in files.numbered_jsonl(spark, str(tmp_path / "b.jsonl")).collect()) == ["x", "y"]
    with pytest.raises(Exception, match="a.jsonl, line 3"):
        files.numbered_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


def test_training_table(spark):
    logs = spark.createDataFrame([("c", "EN", 1, 0.5, 0.6), ("c", "EN", 2, 0.7, 0.6), ("c", "EN", 3, 0.7, 0.6), ("c", "FR", 1, None, None)], "category string, language string, epoch int, f1_1 double, macro_f1 double")
    assert sorted(map(tuple, files.training_table(logs).select("category", "language", "epochs", "best_epoch").collect()))[0] == ("c", "EN", 3, 2)


def test_batches_resume(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([(k, [float(k)]) for k in range(50)], "k long, v array<double>")
    assert sinks.batched(sinks.float_vectors(df, "v"), str(tmp_path / "v"), "k", 4) == 4
    (tmp_path / "v" / "batch=2" / "_SUCCESS").unlink()
    shutil.rmtree(tmp_path / "v" / "batch=3")
    assert sinks.batched(sinks.float_vectors(df, "v"), str(tmp_path / "v"), "k", 4) == 2
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == 50 and dict(back.dtypes)["v"] == "array<float>"


def test_partitioned_records(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", "EN", "x"), ("b", "test", "FR", "é")], "label string, split string, language string, text string")
    sinks.jsonl(df, str(tmp_path / "j"), ["label", "split", "language"])
    assert (tmp_path / "j" / "label=b" / "split=test" / "language=FR").is_dir() and spark.read.json(str(tmp_path / "j")).count() == 2


def test_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("a", None)], "code string, kappa double")
    agreement.export(str(tmp_path), {"overall": df, "per_label": df}, {"overall": ["code"], "per_label": ["code"]})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["overall", "per_label"]
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "overall"), header=True).collect()] == [("a", "--"), ("b", "0.5000")]


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path / 'db'};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no database driver")
    spark.range(50).selectExpr("id as K", "cast(id * 2 as double) as V").write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", driver).save()
    whole = files.jdbc(spark, url, "t", driver=driver)
    parts = files.jdbc(spark, url, "(select * from t where k >= 10) x", ("K", 0, 50, 4), driver=driver)
    assert whole.count() == 50 and parts.count() == 40 and parts.rdd.getNumPartitions() == 4
