"""One callable per registered query: (spark, sf_dir) -> DataFrame over the whole derived churn table."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixed_model
from ebbtide.functions import risk
from ebbtide.functions.reasons import with_contribution_reasons
from ebbtide.operators import checks as rules
from ebbtide.operators import encoding, evaluate, gates, linear, monitoring, reports, selection, smote, weights
from ebbtide.operators.classifiers import MODEL_NAMES, importance_table
from ebbtide.operators.neighbour_descent import descended_neighbours
from ebbtide.operators.neighbours import nearest_neighbours
from ebbtide.operators.tree_contributions import base_value, with_tree_contributions
from ebbtide.plans import features as feature_plan
from ebbtide.plans import search, training
from ebbtide.plans.scoring import ChurnScorer
from ebbtide.session import cut_lineage, shared_dir
from ebbtide.sources import registry, sinks, tables
from checks.derived import customers_churn, customers_dirty, rule_based_probability, training_table
from ebbtide.sources.schema import CATEGORIES
from ebbtide.streaming import scoring_stream

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), digits) for name in names})


# Sources ------------------------------------------------------------------------------------------------------------


@query
def derived_customers(spark, sf_dir):
    return training_table(spark, sf_dir)


@query
def labelled_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "labelled-csv")
    training_table(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_customers(spark, path)


@query
def scoring_csv_round_trip(spark, sf_dir):
    """No label, no total charges, other column order, spelled-out headers."""
    path = scratch(spark, "scoring-csv")
    raw = training_table(spark, sf_dir)
    raw.select(
        "customer_id", "tenure", F.col("monthly_charges").alias("Monthly Charges"),
        F.col("support_calls").alias("SUPPORT CALLS"), "contract_type", "internet_service", "payment_method",
        "number_of_logins", "usage_hours",
    ).write.option("header", True).csv(path)
    return tables.read_customers(spark, path, with_label=False)


def _write_mixed_headers(df: DataFrame, path: str) -> None:
    """The rows as CSV in two layouts: as declared, and turned around with other spellings."""
    turned = {"monthly_charges": "Monthly Charges", "tenure": " TENURE "}
    even = F.crc32("customer_id") % 2 == 0
    df.filter(even).write.option("header", True).csv(f"{path}/a")
    df.filter(~even).select(*reversed(df.columns)).withColumnsRenamed(turned).write.option("header", True).csv(f"{path}/b")


@query
def mixed_header_folder(spark, sf_dir):
    path = scratch(spark, "mixed-csv")
    _write_mixed_headers(training_table(spark, sf_dir), path)
    return tables.read_customers(spark, f"{path}/*")


@query
def result_csv_round_trip(spark, sf_dir):
    """Scored rows written as CSV parts and read back."""
    path = scratch(spark, "results")
    sinks.write_results_csv(_scored(spark, sf_dir), path)
    types = "customer_id string, churn_probability double, churn_label int, risk_segment string, expected_revenue_loss double, retention_strategy string, top_reasons string"
    return spark.read.option("header", True).schema(types).csv(path)


@query
def normalised_headers(spark, sf_dir):
    odd = {"monthly_charges": " Monthly Charges ", "tenure": "  Tenure", "contract_type": "Contract   Type"}
    return tables.normalise_headers(training_table(spark, sf_dir).withColumnsRenamed(odd))


@query
def customer_id_fallback(spark, sf_dir):
    """Every fifth id emptied; the row number of the file takes its place."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    numbered = tables.with_row_numbers(customer)
    blank = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.format_string("CUST-%05d", "c_custkey"))
    return tables.fill_ids(numbered.withColumn("customer_id", blank)).select("c_custkey", "customer_id")


# Rules and gates ----------------------------------------------------------------------------------------------------


@query
def value_rule_counts(spark, sf_dir):
    return rules.value_rule_counts(customers_dirty(spark, sf_dir))


@query
def value_rule_offenders(spark, sf_dir):
    return rules.value_rule_offenders(customers_dirty(spark, sf_dir), "negative_tenure")


@query
def record_violations(spark, sf_dir):
    checked = rules.with_violations(customers_dirty(spark, sf_dir))
    return checked.select("customer_id", risk.join_texts(F.col("violations")).alias("violations"))


@query
def rejected_rows(spark, sf_dir):
    """Rejects of a file, with their position in it."""
    path = scratch(spark, "dirty-csv")
    dirty = customers_dirty(spark, sf_dir).orderBy("c_custkey").drop("c_custkey", "c_nationkey", "churn")
    dirty.write.option("header", True).csv(path)
    rows = tables.read_customers(spark, path, with_label=False, malformed="collect", row_ids=True)
    _, rejects = fixed_model.scorer().score_lenient(rows)
    return rejects.select("source_row_id", "customer_id", risk.join_texts(F.col("violations")).alias("violations"))


@query
def strict_batch(spark, sf_dir):
    """A batch that must be clean: rows that break a rule, and whether the batch was refused for them."""
    dirty = customers_dirty(spark, sf_dir)
    try:
        fixed_model.scorer().score_strict(dirty)
        refused = False
    except rules.ValueRuleError:
        refused = True
    bad = F.count_if(F.size("violations") > 0).alias("bad_rows")
    return rules.with_violations(dirty).agg(bad).withColumn("refused", F.lit(refused))


@query
def accepted_rows_scored(spark, sf_dir):
    scored, _ = fixed_model.scorer().score_lenient(customers_dirty(spark, sf_dir))
    return reports.result_table(scored)


@query
def column_null_rates(spark, sf_dir):
    dirty = customers_dirty(spark, sf_dir).drop("c_custkey", "c_nationkey")
    return rounded(gates.null_rates(dirty), "null_rate")


@query
def churn_rate_gate(spark, sf_dir):
    return rounded(gates.label_rate(training_table(spark, sf_dir)), "churn_rate")


def _with_copies(spark, sf_dir) -> DataFrame:
    table = customers_churn(spark, sf_dir)
    return table.unionByName(table.filter(F.col("c_custkey") % 50 == 0))


@query
def duplicate_customer_ids(spark, sf_dir):
    return gates.duplicate_ids(_with_copies(spark, sf_dir))


def _spoiled(spark, sf_dir) -> DataFrame:
    """The dirty table with threefold copies, rows without an id, and a column of another type."""
    dirty = customers_dirty(spark, sf_dir)
    copies = dirty.filter(F.col("c_custkey") % 50 == 0)
    table = dirty.unionByName(copies).unionByName(copies)
    known = F.when(F.col("c_custkey") % 41 != 0, F.col("customer_id"))
    return table.withColumns({"customer_id": known, "support_calls": F.col("support_calls").cast("bigint")}).drop("c_custkey", "c_nationkey")


@query
def data_gate_table(spark, sf_dir):
    return rounded(gates.data_gates(_spoiled(spark, sf_dir)), "value")


@query
def segments_of_unscored_rows(spark, sf_dir):
    """Every seventh probability is missing: no segment and no label for it."""
    rows = _labelled_scores(spark, sf_dir).withColumn("p", F.when(F.substring("customer_id", 6, 20).cast("bigint") % 7 > 0, F.col("churn_probability")))
    return rows.select("customer_id", risk.risk_segment(F.col("p")).alias("risk_segment"), risk.churn_label(F.col("p")).alias("churn_label"))


@query
def metrics_with_a_null_group(spark, sf_dir):
    """Metrics by contract, where one contract is not known."""
    table = training_table(spark, sf_dir)
    scored = fixed_model.scorer().probabilities(table).select("contract_type", "churn", F.round("churn_probability", 4).alias("p"))
    rows = scored.withColumn("contract", F.when(F.col("contract_type") != "Two Year", F.col("contract_type")))
    return evaluate.all_metrics(rows, "p", by=["contract"])


# Features and encoding ----------------------------------------------------------------------------------------------


@query
def imputed_customers(spark, sf_dir):
    return encoding.impute(training_table(spark, sf_dir)).select(
        "customer_id", "total_charges", "number_of_logins", "usage_hours"
    )


@query
def imputed_absent_columns(spark, sf_dir):
    bare = training_table(spark, sf_dir).drop("total_charges", "number_of_logins", "usage_hours")
    return encoding.impute(bare).select("customer_id", "total_charges", "number_of_logins", "usage_hours")


@query
def usage_maxima(spark, sf_dir):
    return encoding.usage_maxima(encoding.impute(training_table(spark, sf_dir)))


@query
def engineered_features(spark, sf_dir):
    return feature_plan.engineer_features(training_table(spark, sf_dir))


@query
def churn_by_tenure_group_and_contract(spark, sf_dir):
    table = feature_plan.engineer_features(training_table(spark, sf_dir), check=False)
    return table.groupBy("tenure_group", "contract_type").agg(
        F.count("*").alias("customers"),
        reports.churn_rate_pct().alias("churn_rate_pct"),
        F.round(F.avg("customer_lifetime_value"), 4).alias("avg_lifetime_value"),
    )


@query
def category_vocabulary(spark, sf_dir):
    return encoding.vocabulary_table(training_table(spark, sf_dir))


@query
def encoded_customers(spark, sf_dir):
    """Ordinal and one-hot columns with a vocabulary and maxima fitted on the whole table, identifiers dropped."""
    table = training_table(spark, sf_dir)
    state = encoding.fit_encoder(encoding.impute(table))
    return encoding.encode(feature_plan.engineer_features(table, (state.max_logins, state.max_usage)), state)


@query
def unseen_categories_encoded(spark, sf_dir):
    """Clean vocabulary on the dirty table: a contract never seen gives zeros, and the first class as label code."""
    dirty = customers_dirty(spark, sf_dir)
    classes = sorted(CATEGORIES["contract_type"])
    coded = dirty.withColumn("contract_code", encoding.label_codes(F.col("contract_type"), classes))
    return encoding.one_hot(coded, "contract_type", classes).select(
        "customer_id", "contract_code", "contract_type_One Year", "contract_type_Two Year"
    )


@query
def aligned_matrix(spark, sf_dir):
    """A feature list with one name the table lacks and without one it has."""
    table = training_table(spark, sf_dir)
    rows = encoding.encode(encoding.engineered(encoding.impute(table), 22.0, 305.0), fixed_model.STATE)
    return encoding.align(rows, [*fixed_model.FEATURES[:-1], "region_score"], ("customer_id",))


@query
def features_and_label(spark, sf_dir):
    table = encoding.engineered(encoding.impute(training_table(spark, sf_dir)), 22.0, 305.0)
    names = ["tenure", "monthly_charges", "customer_lifetime_value", "charge_ratio"]
    return encoding.features_and_label(encoding.drop_identifiers(table), names)


# Reports ------------------------------------------------------------------------------------------------------------


@query
def overview(spark, sf_dir):
    return rounded(
        reports.overview(training_table(spark, sf_dir)), "churn_rate", "avg_monthly_charges", "avg_tenure"
    )


@query
def churn_counts(spark, sf_dir):
    return reports.churn_counts(training_table(spark, sf_dir))


@query
def churn_rate_by_contract(spark, sf_dir):
    return reports.churn_rate_by(training_table(spark, sf_dir), "contract_type")


@query
def churn_rate_by_tenure_bucket(spark, sf_dir):
    return reports.churn_rate_by_tenure_bucket(training_table(spark, sf_dir))


@query
def churn_rate_by_support_calls(spark, sf_dir):
    return reports.churn_rate_by(training_table(spark, sf_dir), "support_calls")


@query
def charges_histogram(spark, sf_dir):
    return reports.charges_histogram(training_table(spark, sf_dir))


@query
def scatter_sample(spark, sf_dir):
    return reports.scatter_sample(training_table(spark, sf_dir))


@query
def preview_rows(spark, sf_dir):
    return reports.preview(training_table(spark, sf_dir), 5)


@query
def exact_medians(spark, sf_dir):
    table = training_table(spark, sf_dir)
    medians = selection.exact_medians(table, ["monthly_charges", "number_of_logins", "usage_hours"])
    return spark.createDataFrame(list(medians.items()), "column_name string, median double")


@query
def rule_based_scores(spark, sf_dir):
    """Model-free probability with the medians of the table as fills."""
    table = training_table(spark, sf_dir)
    fills = selection.exact_medians(table, ["number_of_logins", "usage_hours"])
    probability = rule_based_probability(fills["number_of_logins"], fills["usage_hours"])
    return table.select("customer_id", F.round(probability, 6).alias("churn_probability"))


# Split, folds, scaling, over-sampling -------------------------------------------------------------------------------


@query
def train_test_split(spark, sf_dir):
    return selection.stratified_split(training_table(spark, sf_dir)).select("customer_id", "churn", "split")


@query
def class_balance(spark, sf_dir):
    return rounded(reports.class_balance(selection.stratified_split(training_table(spark, sf_dir))), "churn_pct")


@query
def cross_validation_folds(spark, sf_dir):
    return selection.stratified_folds(training_table(spark, sf_dir)).select("customer_id", "churn", "fold")


@query
def train_test_overlap(spark, sf_dir):
    parts = selection.stratified_split(training_table(spark, sf_dir))
    both = rules.shared_keys(parts.filter("split = 'train'"), parts.filter("split = 'test'"))
    return both.agg(F.count("*").alias("shared_keys"))


def _matrix(spark, sf_dir) -> DataFrame:
    """All rows encoded with the fixed state: id, label and the 18 features."""
    return feature_plan.encode_rows(training_table(spark, sf_dir), fixed_model.STATE)


@query
def scaler_state(spark, sf_dir):
    state = linear.fit_scaler(_matrix(spark, sf_dir), fixed_model.FEATURES)
    rows = [(name, round(m, 6), round(s, 6)) for name, m, s in zip(fixed_model.FEATURES, state.mean, state.scale)]
    return spark.createDataFrame(rows, "feature string, mean double, scale double")


@query
def class_weights(spark, sf_dir):
    return rounded(weights.class_weight_table(training_table(spark, sf_dir)), "weight")


@query
def churner_neighbours(spark, sf_dir):
    """The five nearest churners of every churner, unscaled distance over the 18 features."""
    churners = cut_lineage(_matrix(spark, sf_dir).filter("churn = 1"))
    vec = F.array(*[F.col(f"`{name}`") for name in fixed_model.FEATURES])
    found = nearest_neighbours(churners.select(F.col("customer_id").alias("id"), vec.alias("vec")))
    near = found.select("id", F.posexplode("near").alias("place", "near"))
    return near.select(
        F.col("id").alias("customer_id"), (F.col("place") + 1).alias("rank"),
        F.col("near.id").alias("neighbour_id"), F.round(F.sqrt("near.d2"), 6).alias("distance"),
    )


@query
def neighbour_descent_recall(spark, sf_dir):
    """Share of the true five nearest churners that neighbour descent finds, over all churners."""
    churners = cut_lineage(_matrix(spark, sf_dir).filter("churn = 1"))
    rows = churners.select(F.col("customer_id").alias("id"), F.array(*[F.col(f"`{name}`") for name in fixed_model.FEATURES]).alias("vec"))
    true, found = (f(rows).select("id", F.transform("near", lambda n: n["id"]).alias(name)) for f, name in ((nearest_neighbours, "true"), (descended_neighbours, "found")))
    hits = F.size(F.array_intersect("true", "found"))
    both = true.join(found, "id").agg(F.count("*").alias("churners"), (F.sum(hits) / F.sum(F.size("true")) >= 0.9).alias("recall_reached"))
    return both


@query
def synthetic_churners(spark, sf_dir):
    made = smote.synthetic_rows(cut_lineage(_matrix(spark, sf_dir)), fixed_model.FEATURES)
    return rounded(
        made.select("customer_id", "seed_id", "neighbour_id", "gap", "tenure", "monthly_charges", "usage_hours"),
        "gap", "tenure", "monthly_charges", "usage_hours",
    )


@query
def balanced_class_counts(spark, sf_dir):
    more = smote.oversample(cut_lineage(_matrix(spark, sf_dir)), fixed_model.FEATURES)
    return more.groupBy("churn").agg(F.count("*").alias("customers"))


# Scoring with fixed coefficients --------------------------------------------------------------------------------------


def _unlabelled(spark, sf_dir) -> DataFrame:
    return training_table(spark, sf_dir).drop("churn")


def _scored(spark, sf_dir, keep=("customer_id",)) -> DataFrame:
    return fixed_model.scorer().score(customers_churn(spark, sf_dir).drop("churn"), keep=keep)


@query
def churn_probabilities(spark, sf_dir):
    rows = fixed_model.scorer().probabilities(_unlabelled(spark, sf_dir))
    return rows.select("customer_id", F.round("churn_probability", 6).alias("churn_probability"))


@query
def scored_customers(spark, sf_dir):
    """The flat result table, riskiest first."""
    return reports.result_table(reports.scored_by_risk(_scored(spark, sf_dir)))


@query
def retention_with_supplied_engagement(spark, sf_dir):
    """A supplied engagement score (every third customer) overrides the estimate."""
    table = customers_churn(spark, sf_dir)
    given = F.when(F.col("c_custkey") % 3 == 0, F.lit(0.2999)).when(F.col("c_custkey") % 3 == 1, F.lit(0.3))
    scored = fixed_model.scorer().score(table.withColumn("engagement_score", given))
    return scored.select("customer_id", risk.join_texts(F.col("retention_strategy")).alias("retention_strategy"))


@query
def linear_contributions(spark, sf_dir):
    """Coefficient times distance from the mean of all rows, in long form."""
    rows = _matrix(spark, sf_dir)
    parts = fixed_model.linear().with_background(rows).contributions()
    pairs = [F.struct(F.lit(n).alias("feature"), F.round(p, 6).alias("contribution")) for n, p in zip(fixed_model.FEATURES, parts)]
    return rows.select("customer_id", F.explode(F.array(*pairs)).alias("part")).select("customer_id", "part.*")


@query
def contribution_reasons_text(spark, sf_dir):
    scored = fixed_model.scorer().score(_unlabelled(spark, sf_dir), reasons="contributions")
    return scored.select("customer_id", risk.join_texts(F.col("top_reasons")).alias("top_reasons"))


@query
def segment_distribution(spark, sf_dir):
    counts = reports.segment_distribution(_scored(spark, sf_dir))
    return counts.withColumn("display", risk.segment_display(F.col("risk_segment")))


@query
def batch_summary(spark, sf_dir):
    return reports.batch_summary(_scored(spark, sf_dir))


def _log(spark, sf_dir) -> DataFrame:
    """One batch per nation."""
    scored = _scored(spark, sf_dir, keep=("customer_id", "c_nationkey"))
    return monitoring.batch_log(scored.withColumnRenamed("c_nationkey", "batch_id"))


@query
def monitoring_log(spark, sf_dir):
    return monitoring.with_alerts(_log(spark, sf_dir))


@query
def monitoring_trend(spark, sf_dir):
    return rounded(monitoring.trend(_log(spark, sf_dir)), "avg_prob_change", "high_risk_pct_change", digits=4)


@query
def latest_batch(spark, sf_dir):
    return monitoring.latest(_log(spark, sf_dir))


@query
def monitoring_history(spark, sf_dir):
    return monitoring.history(_log(spark, sf_dir))


@query
def appended_log(spark, sf_dir):
    """Two appends of half the batches each, read back."""
    path, log = scratch(spark, "log"), cut_lineage(_log(spark, sf_dir))
    for half in (0, 1):
        monitoring.append_log(log.filter(F.col("batch_id") % 2 == half), path)
    return spark.read.schema(log.schema).parquet(path)


@query
def stream_scoring_log(spark, sf_dir):
    """Two arrivals of files in two layouts, each scored as one micro-batch of a stream; one log row for each."""
    root, table = scratch(spark, "stream"), customers_churn(spark, sf_dir)
    names = _unlabelled(spark, sf_dir).columns
    for half in (0, 1):
        _write_mixed_headers(table.filter(F.col("c_nationkey") % 2 == half).select(*names), f"{root}/in/{half}")
        stream = scoring_stream.customer_stream(spark, f"{root}/in/*/*")
        scoring_stream.start_scoring(
            fixed_model.scorer(), stream, "csv", f"{root}/out", f"{root}/state", available_now=True
        ).awaitTermination()
    log = scoring_stream.monitoring_log(spark, f"{root}/out").drop("batch_time")
    return log.withColumn("batch_id", F.col("batch_id").cast("bigint"))


# Metrics ------------------------------------------------------------------------------------------------------------


def _labelled_scores(spark, sf_dir, with_folds: bool = False) -> DataFrame:
    """Probability (to 4 digits, so that ties occur) and label of every customer."""
    table = training_table(spark, sf_dir)
    table = selection.stratified_folds(table) if with_folds else table
    scored = fixed_model.scorer().probabilities(table)
    keep = ["fold"] if with_folds else []
    return scored.select("customer_id", "churn", *keep, F.round("churn_probability", 4).alias("churn_probability"))


@query
def confusion_counts(spark, sf_dir):
    return evaluate.confusion(_labelled_scores(spark, sf_dir), "churn_probability")


@query
def threshold_metrics(spark, sf_dir):
    scores = _labelled_scores(spark, sf_dir)
    return rounded(evaluate.threshold_metrics(scores, "churn_probability"), "precision", "recall", "f1")


@query
def ranking_metrics(spark, sf_dir):
    scores = _labelled_scores(spark, sf_dir)
    return rounded(evaluate.ranking_metrics(scores, "churn_probability"), "roc_auc", "pr_auc")


@query
def fold_metrics(spark, sf_dir):
    scores = _labelled_scores(spark, sf_dir, with_folds=True)
    return rounded(evaluate.ranking_metrics(scores, "churn_probability", by=["fold"]), "roc_auc", "pr_auc")


@query
def fold_summary(spark, sf_dir):
    scores = _labelled_scores(spark, sf_dir, with_folds=True)
    per_fold = evaluate.ranking_metrics(scores, "churn_probability", by=["fold"])
    return rounded(evaluate.fold_summary(per_fold), "cv_mean", "cv_std")


@query
def profit_curve(spark, sf_dir):
    return evaluate.profit_curve(_labelled_scores(spark, sf_dir), "churn_probability", 500, 120)


@query
def most_profitable_threshold(spark, sf_dir):
    curve = evaluate.profit_curve(_labelled_scores(spark, sf_dir), "churn_probability", 500, 120)
    return evaluate.best_threshold(curve)


def _runs(spark, sf_dir) -> DataFrame:
    """Three fixed scorers compared on the whole table, in the shape of a training run table; the table is read once."""
    rows = fixed_model.scorer().probabilities(training_table(spark, sf_dir))
    scored = []
    for order, (name, flag, drop) in enumerate(fixed_model.RUNS):
        p = F.round(fixed_model.linear(drop).probability(), 4)
        scored.append(F.struct(F.lit(order).alias("run_order"), F.lit(name).alias("model_name"), F.lit(flag).alias("smote"), p.alias("p")))
    together = rows.select("churn", F.explode(F.array(*scored)).alias("run")).select("churn", "run.*")
    by = ["run_order", "model_name", "smote"]
    metrics = evaluate.all_metrics(together, "p", by=by)
    return metrics.select(
        "run_order", risk.run_id(F.col("model_name"), F.col("smote")).alias("run_id"), "model_name", "smote",
        F.lit(None).cast("double").alias("cv_roc_auc"), F.lit(None).cast("double").alias("cv_roc_auc_std"),
        F.col("roc_auc").alias("test_roc_auc"), F.col("pr_auc").alias("test_pr_auc"),
        F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"), F.col("f1").alias("test_f1"),
    )


@query
def run_comparison(spark, sf_dir):
    return reports.run_comparison(_runs(spark, sf_dir)).drop("cv_roc_auc", "cv_roc_auc_std")


@query
def best_run(spark, sf_dir):
    return reports.best_run(_runs(spark, sf_dir)).select("run_id", "test_roc_auc")


@query
def run_table(spark, sf_dir):
    return reports.run_table(_runs(spark, sf_dir)).drop("CV AUC")


@query
def run_metadata_round_trip(spark, sf_dir):
    """Runs written as one JSON document and read back as rows."""
    path, runs = scratch(spark, "metadata"), cut_lineage(_runs(spark, sf_dir))
    best = reports.best_run(runs).first()["run_id"]
    registry.write_run_metadata(runs, path, best, fixed_model.FEATURES, "2001-08-01T00:00:00+00:00", 42, 5)
    metadata = registry.read_metadata(spark, path)
    names = registry.best_model_record(metadata).select(F.col("run_id").alias("best_run_id"), "n_features", "trained_at")
    return registry.runs_from_metadata(metadata).select("run_order", "run_id", "test_roc_auc").join(
        names.withColumn("run_order", F.lit(0)), "run_order", "left"
    )


@query
def model_gate_table(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    metrics = runs.select("run_id", F.col("test_roc_auc").alias("roc_auc"), F.col("test_pr_auc").alias("pr_auc"))
    return gates.model_gates(metrics, ["run_id"])


@query
def coefficient_importances(spark, sf_dir):
    """Absolute coefficients per standard deviation of the given rows, written and read back, largest 15."""
    state = linear.fit_scaler(_matrix(spark, sf_dir), fixed_model.FEATURES)
    rows = [(row[0], round(abs(row[3]) / row[2] * s, 6)) for row, s in zip(fixed_model.TABLE, state.scale)]
    path = scratch(spark, "importances")
    registry.write_importances(spark.createDataFrame(rows, "feature string, importance double"), path)
    return reports.top_importances(registry.read_importances(spark, path))


# Fitted models (compared by their own tests, not by SQL) ---------------------------------------------------------------


@lru_cache(maxsize=2)
def _prepared(spark, application: str, sf_dir):
    return training.prepare(training_table(spark, sf_dir))


def _sets(spark, sf_dir) -> training.TrainingSets:
    """Split, folds and encoded rows with the library's defaults; written once per session and table."""
    return _prepared(spark, spark.sparkContext.applicationId, sf_dir)


@lru_cache(maxsize=8)
def _trained(spark, application: str, sf_dir, models: tuple[str, ...]) -> list[training.Run]:
    sets = _sets(spark, sf_dir)
    return training.train_all(sets, [v for v in training.six_variants() if v.model in models])


def _model_runs(spark, sf_dir, *models: str) -> list[training.Run]:
    """Cross-validated runs of some models, each with and without over-sampling; fitted once per session and table.

    Several models are trained beside each other: one's short jobs run while another's trees grow.
    """
    sets = _sets(spark, sf_dir)
    sets.tables({False, True}, [*range(sets.folds), None])  # what all of them read is written first
    with ThreadPoolExecutor(len(models)) as pool:
        runs = list(pool.map(lambda model: _trained(spark, spark.sparkContext.applicationId, sf_dir, (model,)), models))
    return [run for some in runs for run in some]


def _six_runs(spark, sf_dir) -> list[training.Run]:
    return [replace(run, order=k) for k, run in enumerate(_model_runs(spark, sf_dir, *MODEL_NAMES))]


def _fitted(spark, sf_dir, model: str):
    """A model without over-sampling, fitted on all training rows with the library's defaults."""
    return next(run.fitted for run in _model_runs(spark, sf_dir, model) if not run.variant.smote)


@query
def six_variant_runs(spark, sf_dir):
    """All six variants with the library's defaults: folds with a score, trees, and the rows the last fit saw by class."""
    rows = [
        (run.order, run.variant.run_id, run.variant.model, run.variant.smote, len(run.fold_scores), sum(x is None for x in run.fold_scores),
         len(run.fitted.trees.roots) if run.fitted.trees else 0, *run.fit_rows)
        for run in _six_runs(spark, sf_dir)
    ]
    return spark.createDataFrame(
        rows, "run_order int, run_id string, model_name string, smote boolean, folds long, unscored_folds long, trees long, negatives long, positives long"
    )


@query
def six_variant_metrics(spark, sf_dir):
    """The trained runs ranked by test ROC-AUC, with cross-validated mean and deviation."""
    return reports.run_comparison(training.runs_frame(spark, _six_runs(spark, sf_dir)))


@query
def logistic_regression_runs(spark, sf_dir):
    """Cross-validated logistic regression with and without over-sampling."""
    return training.runs_frame(spark, _model_runs(spark, sf_dir, "logistic_regression"))


@query
def tree_model_runs(spark, sf_dir):
    """Forest and boosting, each with and without over-sampling, cross-validated and refitted."""
    return training.runs_frame(spark, _six_runs(spark, sf_dir)[2:])


@query
def forest_importances(spark, sf_dir):
    return reports.top_importances(importance_table(spark, _fitted(spark, sf_dir, "random_forest")))


@query
def tree_contribution_reasons(spark, sf_dir):
    """Contribution sentences from the boosted ensemble for all rows."""
    sets, fitted = _sets(spark, sf_dir), _fitted(spark, sf_dir, "gradient_boosting")
    explained = with_tree_contributions(fitted.transform(sets.train.drop("fold").unionByName(sets.test)), fitted)
    parts = [F.element_at("contributions", i + 1) for i in range(len(sets.features))]
    told = with_contribution_reasons(explained, sets.features, parts)
    return told.select("customer_id", risk.join_texts(F.col("top_reasons")).alias("top_reasons"))


@query
def fitted_logistic_minimum(spark, sf_dir):
    """Gradient of the stated objective at the fitted coefficients: nothing left to gain along any of them."""
    sets, fitted = _sets(spark, sf_dir), _fitted(spark, sf_dir, "logistic_regression")
    model, names = fitted.linear, [*sets.features, "intercept"]
    weight, total = weights.class_weight_column(sets.train)
    off = weight * (model.probability() - F.col("churn")) / F.lit(total)
    along = [*linear.scaled_columns(model.features, model.scaler), F.lit(1.0)]
    slopes = sets.train.agg(*[F.sum(off * x).alias(n) for n, x in zip(names, along, strict=True)]).first()
    pulls = [*(b / (fitted.variant.params["C"] * total) for b in model.coefficients), 0.0]
    rows = [(n, round(abs(s + pull), 9)) for n, s, pull in zip(names, slopes, pulls, strict=True)]
    return spark.createDataFrame(rows, "parameter string, slope double")


@query
def saved_scorer_scores_again(spark, sf_dir):
    """A fitted scorer saved, loaded and applied to the whole table: rows scored, and rows whose score differs."""
    sets, path = _sets(spark, sf_dir), scratch(spark, "scorer")
    scorer = training.scorer_of(sets, _fitted(spark, sf_dir, "logistic_regression"))
    scorer.save(spark, path)
    rows = _unlabelled(spark, sf_dir)
    first = scorer.score(rows).select("customer_id", F.col("churn_probability").alias("first"))
    again = ChurnScorer.load(spark, path).score(rows).select("customer_id", F.col("churn_probability").alias("again"))
    return first.join(again, "customer_id").agg(F.count("*").alias("scored"), F.count_if(~F.col("first").eqNullSafe(F.col("again"))).alias("different"))


@query
def contributions_add_up(spark, sf_dir):
    """Tree contributions of every customer: base value and contributions make up the predicted log-odds."""
    sets, fitted = _sets(spark, sf_dir), _fitted(spark, sf_dir, "gradient_boosting")
    explained = with_tree_contributions(fitted.transform(sets.train.drop("fold").unionByName(sets.test)), fitted)
    made = F.lit(base_value(fitted)) + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    p = F.col("churn_probability")
    return explained.agg(F.count("*").alias("explained"), F.round(F.max(F.abs(made - F.log(p / (1 - p)))), 6).alias("largest_residual"))


@query
def importances_add_up(spark, sf_dir):
    """Importances of a forest: one per feature, summing to 1."""
    return importance_table(spark, _fitted(spark, sf_dir, "random_forest")).agg(F.countDistinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"))


@lru_cache(maxsize=2)
def _search(spark, application: str, sf_dir) -> search.SearchResult:
    return search.optimise(_sets(spark, sf_dir), "logistic_regression")


def _searched(spark, sf_dir) -> search.SearchResult:
    return _search(spark, spark.sparkContext.applicationId, sf_dir)


@query
def search_trials(spark, sf_dir):
    """Adaptive search over the logistic regression space on over-sampled folds: 50 trials, those that fall behind pruned."""
    return search.trials_frame(spark, _searched(spark, sf_dir))


@query
def tuned_metadata_round_trip(spark, sf_dir):
    """The search's record, written and read: what was asked, and whether gain and best trial are what the trials say."""
    sets, result, path = _sets(spark, sf_dir), _searched(spark, sf_dir), scratch(spark, "tuned")
    registry.write_tuned_metadata(search.tuned_frame(spark, sets, result), path)
    best = search.trials_frame(spark, result).where("state = 'complete'").agg(F.round(F.max("cv_roc_auc"), 4).alias("best"))
    told = registry.read_tuned_metadata(spark, path).crossJoin(best)  # one row each
    gain = F.round(F.col("test_roc_auc") - F.col("baseline_test_auc"), 4)
    return told.select(
        "model_name", "use_smote", "n_trials", "cv_folds", F.size("best_params").alias("parameters"),
        F.abs(F.col("improvement") - gain).alias("gain_off"), F.round(F.abs(F.col("best_cv_roc_auc") - F.col("best")), 4).alias("best_off"),
    )


@query
def whole_training_job(spark, sf_dir):
    """From a CSV folder to a saved scorer, metadata and importances: what was written, and rows the saved scorer scores."""
    data, out = scratch(spark, "training-csv"), scratch(spark, "training-out")
    training_table(spark, sf_dir).write.option("header", True).csv(data)
    variants = [v for v in training.six_variants() if v.model == "logistic_regression"]
    training.run_training(spark, data, out, variants=variants)
    metadata = registry.read_metadata(spark, f"{out}/model_metadata")
    runs = registry.runs_from_metadata(metadata).agg(F.count("*").alias("runs"), F.count("cv_roc_auc").alias("validated"))
    best = registry.best_model_record(metadata).select("n_features")
    importances = registry.read_importances(spark, f"{out}/feature_importance").agg(F.count("*").alias("importances"))
    scored = ChurnScorer.load(spark, f"{out}/best_model").score(_unlabelled(spark, sf_dir)).agg(F.count("churn_probability").alias("scored"))
    return runs.crossJoin(best).crossJoin(importances).crossJoin(scored)  # one row each


@query
def contribution_reasons_by_model(spark, sf_dir):
    """Rows told their reasons by the model's own contributions, for a linear and a boosted model."""
    sets, rows, found = _sets(spark, sf_dir), _unlabelled(spark, sf_dir), []
    for model in ("logistic_regression", "gradient_boosting"):
        scorer = training.scorer_of(sets, _fitted(spark, sf_dir, model))
        # Written first: a condition on the texts would be pushed down as a copy of all that they are made of.
        told = cut_lineage(scorer.score(rows, reasons="contributions").select("top_reasons"))
        found.append(told.agg(F.count_if(F.size("top_reasons") > 0).alias("told")).withColumn("model_name", F.lit(model)))
    return found[0].unionByName(found[1])
