"""The stream gives the batch result, logs every micro-batch, and survives a repeated batch."""

import pytest
from pyspark.sql import functions as F

from checks import fixed_model
from ebbtide.operators import monitoring
from ebbtide.sources import tables
from checks.derived import customers_dirty
from ebbtide.sources.schema import customer_schema
from ebbtide.streaming import scoring_stream as stream

NAMES = customer_schema(with_label=False).names


def write_files(df, path, fmt):
    for part in range(3):
        rows = df.filter(F.col("c_custkey") % 3 == part).select(*NAMES).coalesce(1)
        writer = rows.write.mode("append")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, fmt):
    dirty, scorer = customers_dirty(spark, sf_dir), fixed_model.scorer()
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_files(dirty, source, fmt)
    for _ in range(2):
        arriving = stream.customer_stream(spark, source, files_per_batch=1)
        stream.start_scoring(scorer, arriving, fmt, out, state, available_now=True).awaitTermination()
    scored, rejects = scorer.score_lenient(dirty.select(*NAMES))
    written = spark.read.parquet(f"{out}/scored").drop("batch_id")
    assert written.count() == scored.count() and written.exceptAll(scored).count() == 0
    assert spark.read.parquet(f"{out}/rejects").count() == rejects.count() > 0
    log = stream.monitoring_log(spark, out)
    assert log.count() == 3 and log.agg(F.sum("total")).first()[0] == scored.count()
    assert log.filter("batch_time IS NULL").count() == 0 and "Time" in monitoring.history(log).columns
    assert monitoring.latest(log).first()["batch_id"] == 2 and monitoring.trend(log).count() == 3


def test_repeated_batch_overwrites_itself(spark, sf_dir, tmp_path):
    rows, out = customers_dirty(spark, sf_dir).select(*NAMES), str(tmp_path / "out")
    for _ in range(2):
        stream.write_batch(fixed_model.scorer(), rows, 5, out)
    assert stream.monitoring_log(spark, out).count() == 1
    assert spark.read.parquet(f"{out}/scored").count() + spark.read.parquet(f"{out}/rejects").count() == rows.count()


def test_batch_without_a_good_row(spark, sf_dir, tmp_path):
    rows, out = customers_dirty(spark, sf_dir).filter("tenure < 0").select(*NAMES), str(tmp_path / "out")
    stream.write_batch(fixed_model.scorer(), rows, 1, out)
    assert spark.read.parquet(f"{out}/rejects").count() == rows.count()
    assert stream.monitoring_log(spark, out).count() == 0


def test_stream_reads_headers_and_malformed_cells_like_a_batch(spark, tmp_path):
    """Other column order, no total charges, cells that are no numbers, NULL tokens: the batch path and the stream agree."""
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        "customer_id,tenure,monthly_charges,support_calls,contract_type,internet_service,payment_method,number_of_logins\n"
        "K-1,7,620.5,1,One Year,DSL,Mailed Check,12\nK-2,7,620.5,1,One Year,DSL,Mailed Check,xyz\nK-3,7,abc,1,One Year,DSL,Mailed Check,N/A\n"
    )
    (tmp_path / "in" / "b.csv").write_text(
        "Monthly Charges,Tenure,support_calls,contract_type,internet_service,payment_method,customer_id\n410.0,24,12.0,Two Year,No,Credit Card,K-4\n"
    )
    scorer = fixed_model.scorer()
    scored, rejects = scorer.score_lenient(tables.read_customers(spark, source, with_label=False, malformed="collect"))
    stream.start_scoring(scorer, stream.customer_stream(spark, source), "csv", out, state, available_now=True).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{out}/scored").drop("batch_id").collect())) == sorted(map(str, scored.collect()))
    told = {r["customer_id"]: r["violations"] for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert told == {r["customer_id"]: r["violations"] for r in rejects.collect()} and set(told) == {"K-2", "K-3"}
    assert {r["customer_id"] for r in scored.collect()} == {"K-1", "K-4"}


def test_trend_on_the_stream_equals_the_batch_trend_after_a_restart(spark, sf_dir, tmp_path):
    table, out, state = customers_dirty(spark, sf_dir), str(tmp_path / "trend"), str(tmp_path / "state")
    logs = {name: str(tmp_path / name) for name in ("first", "second")}

    def batch(name, number):
        rows = table.filter(F.col("c_custkey") % 4 == number % 4).select(*NAMES)
        stream.write_batch(fixed_model.scorer(), rows, number, logs[name])

    def follow():
        stream.start_trend(spark, logs, out, state, available_now=True).awaitTermination()

    for number in (0, 1):
        batch("first", number)
    batch("second", 0)
    follow()
    batch("first", 1)  # run again after a failure: seen before
    for number in (2, 3):
        batch("first", number)
    batch("second", 5)
    follow()
    follow()
    for name, folder in logs.items():
        log = stream.monitoring_log(spark, folder)
        expected = monitoring.trend(log).join(log.select("batch_id", "alert", "probability_status"), "batch_id")
        found = spark.read.parquet(out).where(F.col("scorer") == name).select(*expected.columns)
        assert sorted(map(str, found.withColumn("batch_id", F.col("batch_id").cast("int")).collect())) == sorted(map(str, expected.collect()))
