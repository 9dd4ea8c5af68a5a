"""Readers: header spelling, column order, missing values, malformed cells, records, ids."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import fixed_model
from ebbtide.operators import checks
from ebbtide.operators.encoding import impute
from ebbtide.operators.gates import type_faults
from tests.conftest import plan_of
from ebbtide.sources import tables
from ebbtide.sources.schema import SchemaError, ValueRuleError, customer_schema

BATCH = """customer_id,tenure,monthly_charges,support_calls,contract_type,internet_service,payment_method,number_of_logins,usage_hours
K-10,3,905.5,7,Month-to-Month,Fiber Optic,Electronic Check,4,11.5
K-11,48,310,1,Two Year,DSL,Credit Card,33,140
K-12,21,760.25,4,One Year,No,Mailed Check,9,52
K-13,33,505,2,One Year,DSL,Bank Transfer,18,95.5
K-14,9,1010,6,Month-to-Month,Fiber Optic,Bank Transfer,6,17
"""


def write(tmp_path, text):
    path = tmp_path / "customers.csv"
    path.write_text(text)
    return str(path)


def test_scoring_file_without_label_and_total(spark, tmp_path):
    df = tables.read_customers(spark, write(tmp_path, BATCH), with_label=False)
    assert df.count() == 5 and "churn" not in df.columns
    assert df.filter("total_charges IS NOT NULL").count() == 0
    assert impute(df).filter("customer_id = 'K-10'").first()["total_charges"] == 2716.5


def test_label_is_required_after_header_normalisation(spark, tmp_path):
    with pytest.raises(SchemaError, match="churn"):
        tables.read_customers(spark, write(tmp_path, BATCH))
    lines = BATCH.strip().split("\n")
    labelled = "\n".join([lines[0] + ", Churn ", *[line + ",1" for line in lines[1:]]])
    df = tables.read_customers(spark, write(tmp_path, labelled))
    assert df.agg(F.sum("churn")).first()[0] == 5 and type_faults(df) == []


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["  Monthly   Charges ", "TENURE"])
    assert tables.normalise_headers(df).columns == ["monthly_charges", "tenure"]
    with pytest.raises(SchemaError, match="same name"):
        tables.normalise_headers(spark.createDataFrame([(1, 2)], ["Tenure", "tenure "]))


def test_all_missing_columns_are_listed(spark):
    with pytest.raises(SchemaError) as error:
        tables.require_columns(spark.createDataFrame([(1, "x")], ["tenure", "contract_type"]))
    for name in ("monthly_charges", "support_calls", "internet_service", "payment_method"):
        assert name in str(error.value)


def test_missing_tokens_and_nan_are_null(spark, tmp_path):
    text = BATCH.replace("33,140", "NaN,").replace("DSL,Bank Transfer", "No,Bank Transfer")
    df = tables.read_customers(spark, write(tmp_path, text), with_label=False)
    row = df.filter("customer_id = 'K-11'").first()
    assert row["number_of_logins"] is None and row["usage_hours"] is None
    assert df.filter("customer_id = 'K-13'").first()["internet_service"] == "No"
    frame = spark.createDataFrame([(math.nan,), (1.0,)], "usage_hours double")
    assert tables.nan_to_null(frame).filter("usage_hours IS NULL").count() == 1


def test_malformed_cells_fail_or_are_listed(spark, tmp_path):
    text = BATCH.replace("K-11,48", "K-11,sixty").replace("K-13,33", "K-13,33.5").replace("9,52", "9,lots")
    path = write(tmp_path, text)
    with pytest.raises(PySparkException, match="not a value of column"):
        tables.read_customers(spark, path, with_label=False).collect()
    df = tables.read_customers(spark, path, with_label=False, malformed="collect")
    codes = {r["customer_id"]: r["violations"] for r in checks.with_violations(df).collect()}
    assert codes["K-10"] == []
    assert codes["K-11"] == ["missing:tenure", "malformed:tenure"]
    assert codes["K-12"] == ["malformed:usage_hours"]
    assert codes["K-13"] == ["missing:tenure", "malformed:tenure"]


def test_fractional_tenure_in_a_typed_file_is_malformed(spark):
    rows = [("a", 1.0, 10.0, 1.0, "x", "y", "z"), ("b", 1.5, 10.0, 1.0, "x", "y", "z")]
    names = "customer_id string, tenure double, monthly_charges double, support_calls double, contract_type string, internet_service string, payment_method string"
    df = tables.conform(spark.createDataFrame(rows, names), with_label=False, malformed="collect")
    assert [r["malformed_columns"] for r in df.orderBy("customer_id").collect()] == [[], ["tenure"]]


def test_records_leave_unset_fields_null(spark):
    record = {
        "tenure": 11, "monthly_charges": 640, "support_calls": 3, "contract_type": "One Year",
        "internet_service": "DSL", "payment_method": "Credit Card", "usage_hours": None,
    }
    df = tables.customers_from_records(spark, [record])
    assert df.schema == customer_schema(with_label=False)
    row = impute(df).first()
    assert (row["total_charges"], row["number_of_logins"], row["usage_hours"]) == (7040.0, 8.0, 40.0)
    assert row["customer_id"] is None


def test_row_numbers_follow_files_and_places(spark, tmp_path):
    folder = tmp_path / "numbered"
    folder.mkdir()
    lines = [[f"{name}{i:05d},{i}" for i in range(n)] for name, n in (("a", 9000), ("b", 10), ("c", 4000))]
    for name, rows in zip("abc", lines, strict=True):
        (folder / f"{name}.csv").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scan = spark.read.schema("key string, n int").csv(str(folder))
        assert scan.rdd.getNumPartitions() > 5
        rows = {r["source_row_id"]: r["key"] for r in tables.with_row_numbers(scan).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [row.split(",")[0] for rows_ in lines for row in rows_]
    assert rows == dict(enumerate(expected))
    with pytest.raises(SchemaError, match="file scan"):
        tables.with_row_numbers(spark.range(10).groupBy("id").count())


def test_missing_ids_and_rejects_show_positions(spark, tmp_path):
    text = BATCH.replace("K-11,", ",").replace("K-13,33", "K-13,-3")
    rows = tables.read_customers(spark, write(tmp_path, text), with_label=False, malformed="collect", row_ids=True)
    scored, rejects = fixed_model.scorer().score_lenient(rows)
    assert {r["customer_id"] for r in scored.collect()} == {"K-10", "1", "K-12", "K-14"}
    assert [(r["customer_id"], r["source_row_id"]) for r in rejects.collect()] == [("K-13", 3)]


def test_value_rules_and_strict_mode(spark):
    rows = [(f"c{i:02d}", -1 if i < 12 else 5, 0.0 if i == 20 else 9.0) for i in range(30)] + [("n", None, None)]
    df = spark.createDataFrame(rows, "customer_id string, tenure int, monthly_charges double")
    with pytest.raises(ValueRuleError) as error:
        checks.require_valid_values(df)
    assert "negative_tenure: 12 row(s)" in str(error.value) and "'c09'" in str(error.value)
    assert "'c10'" not in str(error.value) and "charges_not_positive: 1 row(s)" in str(error.value)
    good = df.filter("tenure > 0 AND monthly_charges > 0")
    assert checks.require_valid_values(good, None, F.count("*")) == [17]


@pytest.mark.parametrize(
    "change, code",
    [
        ({"tenure": -1}, "range:tenure"), ({"tenure": 721}, "range:tenure"), ({"tenure": None}, "missing:tenure"),
        ({"monthly_charges": 0.0}, "range:monthly_charges"), ({"monthly_charges": 10000.01}, "range:monthly_charges"),
        ({"support_calls": 101}, "range:support_calls"), ({"support_calls": None}, "missing:support_calls"),
        ({"total_charges": -0.01}, "range:total_charges"), ({"number_of_logins": 1001.0}, "range:number_of_logins"),
        ({"usage_hours": 8761.0}, "range:usage_hours"), ({"contract_type": "Weekly"}, "category:contract_type"),
        ({"internet_service": "Cable"}, "category:internet_service"), ({"payment_method": "Crypto"}, "category:payment_method"),
        ({"contract_type": None}, "missing:contract_type"), ({"tenure": 720, "monthly_charges": 10000.0}, None),
    ],
)
def test_every_record_rule(spark, change, code):
    record = {
        "customer_id": "x", "tenure": 0, "monthly_charges": 0.01, "support_calls": 100, "contract_type": "One Year",
        "internet_service": "No", "payment_method": "Bank Transfer", **change,
    }
    df = tables.customers_from_records(spark, [record])
    good, rejects = checks.split_rejects(df)
    assert [r["violations"] for r in rejects.collect()] == ([[code]] if code else [])
    assert good.count() == (0 if code else 1)
    if code:
        with pytest.raises(ValueRuleError):
            checks.require_clean(df)
        with pytest.raises(PySparkException, match=code):
            checks.clean_or_fail(df).collect()
    else:
        assert checks.clean_or_fail(checks.require_clean(df)).count() == 1


def test_files_with_differing_headers_go_together_by_name(spark, tmp_path):
    lines = [line.split(",") for line in BATCH.strip().split("\n")]
    turned = "\n".join(",".join(reversed(cells)) for cells in lines) + "\n"
    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "a.csv").write_text(BATCH)
    (folder / "b.csv").write_text(turned.replace("K-", "L-"))
    (folder / "c.csv").write_text(BATCH.replace("K-", "M-").replace("monthly_charges", "Monthly Charges"))
    df = tables.read_customers(spark, str(folder), with_label=False)
    rows = {r["customer_id"]: r[1:] for r in df.select(*customer_schema(with_label=False).names).collect()}
    assert len(rows) == 15
    for k in range(10, 15):
        assert rows[f"K-{k}"] == rows[f"L-{k}"] == rows[f"M-{k}"]
    (folder / "d.csv").write_text("customer_id,tenure\nN-1,4\n")
    with pytest.raises(SchemaError, match="missing"):
        tables.read_customers(spark, str(folder), with_label=False)


def test_headers_come_from_the_first_buffer_of_each_file(spark, tmp_path):
    import gzip

    (tmp_path / "a b.csv").write_text("k,v\n" + "1,2\n" * 200_000)
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as file:
        file.write("v,k\r\n2,1\n")
    found = tables.first_lines(spark, str(tmp_path))
    assert sorted((name.rsplit("/", 1)[1], line) for name, line in found.items()) == [("a%20b.csv", "k,v"), ("c.csv.gz", "v,k")]
    started = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    tables.first_lines(spark, str(tmp_path))
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup()) == started  # no job: no task reads a file


def test_numbered_rows_scan_their_files_once(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "p"))
    numbered = tables.with_row_numbers(spark.read.parquet(str(tmp_path / "p")))
    assert plan_of(numbered).count("FileScan parquet") == 1
    assert sorted(r["source_row_id"] for r in numbered.collect()) == list(range(1000))
