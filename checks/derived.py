"""The churn table derived from the star-schema tables ``customer``, ``orders`` and ``events``.

Both fact tables are reduced to one row per key (partial aggregation before the exchange, so a hot key is cheap) before
they meet the customer table. Money is summed as whole cents: the order of summation cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.hashing import unit_hash
from ebbtide.functions.rounding import round_even
from ebbtide.sources.schema import DEFAULT_LOGINS, DEFAULT_USAGE


# The terms of the label's formula.
def rule_based_probability(fill_logins: Column | float = DEFAULT_LOGINS, fill_usage: Column | float = DEFAULT_USAGE) -> Column:
    """Churn probability from five linear terms and a clipped sigmoid, from which the label of the derived table is drawn.

    The fills stand in for missing logins and usage: pass the medians of the table, or use the defaults.
    """
    logins = F.coalesce(F.col("number_of_logins"), F.lit(fill_logins))
    usage = F.coalesce(F.col("usage_hours"), F.lit(fill_usage))
    tenure_term = F.lit(2.0) - F.col("tenure") / F.lit(72.0) * F.lit(4.0)
    charge_term = (F.col("monthly_charges") - F.lit(300.0)) / F.lit(900.0) * F.lit(2.5) - F.lit(1.0)
    contract_term = F.when(F.col("contract_type") == "Month-to-Month", 1.5).when(
        F.col("contract_type") == "One Year", 0.0
    ).when(F.col("contract_type") == "Two Year", -1.5)
    support_term = F.col("support_calls") * F.lit(0.25)
    engagement_term = -(logins / F.lit(50.0) + usage / F.lit(200.0))
    score = tenure_term + charge_term + contract_term + support_term + engagement_term - F.lit(2.2)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(score, F.lit(-20.0)), F.lit(20.0))))


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


def customers_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")

    spend = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(_cents("o_totalprice")).alias("cents"),
        F.count("*").alias("n_orders"),
        F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("first_urgent"),
    )
    kind = F.col("event_type")
    usage = events.groupBy("user_id").agg(
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "view").alias("views"),
        F.sum(F.when(kind == "click", _cents("value"))).alias("click_cents"),
    )
    users = events.agg(F.max("user_id") + 1).scalar()

    key = F.col("c_custkey")
    days = F.date_diff(F.lit("2001-08-01").cast("date"), F.col("first_urgent").cast("date"))
    months = F.coalesce(F.floor(days / F.lit(31.0)).cast("int"), F.lit(0))
    mean_price = F.col("cents").cast("double") / F.col("n_orders") / F.lit(100.0)
    charges = F.coalesce(round_even(F.lit(300.0) + mean_price / F.lit(500.0), 2), F.lit(300.0))

    table = (
        customer.select("c_custkey", "c_nationkey", "c_mktsegment", (key % users).alias("user_id"))
        .join(spend, "c_custkey", "left")
        .join(usage, "user_id", "left")
        .select(
            "c_custkey",
            "c_nationkey",
            F.format_string("CUST-%05d", key).alias("customer_id"),
            months.alias("tenure"),
            charges.alias("monthly_charges"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "One Year")
            .when(F.col("c_mktsegment") == "MACHINERY", "Two Year")
            .otherwise("Month-to-Month")
            .alias("contract_type"),
            F.when(F.col("c_nationkey") % 3 == 0, "DSL")
            .when(F.col("c_nationkey") % 3 == 1, "Fiber Optic")
            .otherwise("No")
            .alias("internet_service"),
            F.when(key % 4 == 0, "Electronic Check")
            .when(key % 4 == 1, "Mailed Check")
            .when(key % 4 == 2, "Bank Transfer")
            .otherwise("Credit Card")
            .alias("payment_method"),
            (F.coalesce("errors", F.lit(0)) % 11).cast("int").alias("support_calls"),
            F.when(key % 33 != 0, F.coalesce("views", F.lit(0)).cast("double")).alias("number_of_logins"),
            F.when(
                key % 33 != 2,
                round_even(F.coalesce("click_cents", F.lit(0)).cast("double") / F.lit(500.0), 1),
            ).alias("usage_hours"),
        )
    )
    table = table.withColumn(
        "total_charges",
        F.when(key % 33 != 1, round_even(F.col("monthly_charges") * F.col("tenure") + key % 500, 2)),
    )
    return table.withColumn("churn", (unit_hash(key, "churn") < rule_based_probability()).cast("int"))


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table with the columns of a labelled customer file only."""
    return customers_churn(spark, sf_dir).select(
        "customer_id", "tenure", "monthly_charges", "total_charges", "contract_type", "internet_service",
        "payment_method", "support_calls", "number_of_logins", "usage_hours", "churn",
    )


def customers_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table with broken rows mixed in, for the rejects and gate queries."""
    fault = F.col("c_custkey") % 97
    return customers_churn(spark, sf_dir).withColumns(
        {
            "tenure": F.when(fault == 0, F.lit(-1)).otherwise(F.col("tenure")),
            "monthly_charges": F.when(fault == 1, F.lit(0.0)).otherwise(F.col("monthly_charges")),
            "contract_type": F.when(fault == 2, F.lit("Weekly")).otherwise(F.col("contract_type")),
            "support_calls": F.when(fault != 3, F.col("support_calls")),
        }
    )
