"""The SQL each registered query must equal, built from shared table expressions."""

from __future__ import annotations

from checks import fixed_model

SQL = {}


def rint(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


def exact(x: str, digits: int) -> str:
    """Round the exact binary value half to even."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def unit(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::UBIGINT / 4294967296e0)"


def order(key: str, seed: str) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 15))::UBIGINT"


def rule_probability(logins: str = "8e0", usage: str = "40e0") -> str:
    score = (
        "2e0 - tenure / 72e0 * 4e0"
        " + ((monthly_charges - 300e0) / 900e0 * 2.5e0 - 1e0)"
        " + CASE contract_type WHEN 'Month-to-Month' THEN 1.5e0 WHEN 'One Year' THEN 0e0 WHEN 'Two Year' THEN -1.5e0 END"
        " + support_calls * 0.25e0"
        f" + -(coalesce(number_of_logins, {logins}) / 50e0 + coalesce(usage_hours, {usage}) / 200e0)"
        " - 2.2e0"
    )
    return f"(1e0 / (1e0 + exp(-least(greatest({score}, -20e0), 20e0))))"


DERIVED = f"""
spend AS (
  SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n_orders,
         min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS first_urgent
  FROM orders GROUP BY o_custkey),
by_user AS (
  SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors,
         count(*) FILTER (WHERE event_type = 'view') AS views,
         sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END)::BIGINT AS click_cents
  FROM events GROUP BY user_id),
joined AS (
  SELECT c_custkey, c_nationkey, printf('CUST-%05d', c_custkey) AS customer_id,
    coalesce(CAST(floor(date_diff('day', CAST(first_urgent AS DATE), DATE '2001-08-01') / 31e0) AS INT), 0) AS tenure,
    coalesce({rint('300e0 + cents::DOUBLE / n_orders / 100e0 / 500e0', 2)}, 300e0) AS monthly_charges,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'One Year' WHEN 'MACHINERY' THEN 'Two Year' ELSE 'Month-to-Month' END
      AS contract_type,
    CASE c_nationkey % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber Optic' ELSE 'No' END AS internet_service,
    CASE c_custkey % 4 WHEN 0 THEN 'Electronic Check' WHEN 1 THEN 'Mailed Check' WHEN 2 THEN 'Bank Transfer'
      ELSE 'Credit Card' END AS payment_method,
    CAST(coalesce(errors, 0) % 11 AS INT) AS support_calls,
    CASE WHEN c_custkey % 33 <> 0 THEN coalesce(views, 0)::DOUBLE END AS number_of_logins,
    CASE WHEN c_custkey % 33 <> 2 THEN {rint('coalesce(click_cents, 0)::DOUBLE / 500e0', 1)} END AS usage_hours
  FROM customer
  LEFT JOIN spend ON o_custkey = c_custkey
  LEFT JOIN by_user ON by_user.user_id = c_custkey % (SELECT max(user_id) + 1 FROM events)),
charged AS (
  SELECT *, CASE WHEN c_custkey % 33 <> 1
    THEN {rint('monthly_charges * tenure + c_custkey % 500', 2)} END AS total_charges FROM joined),
full_table AS (
  SELECT *, CAST({unit('c_custkey', 'churn')} < {rule_probability()} AS INT) AS churn FROM charged),
churners AS (
  SELECT customer_id, tenure, monthly_charges, total_charges, contract_type, internet_service, payment_method,
         support_calls, number_of_logins, usage_hours, churn FROM full_table),
dirty AS (
  SELECT * REPLACE (
    CASE WHEN c_custkey % 97 = 0 THEN -1 ELSE tenure END AS tenure,
    CASE WHEN c_custkey % 97 = 1 THEN 0e0 ELSE monthly_charges END AS monthly_charges,
    CASE WHEN c_custkey % 97 = 2 THEN 'Weekly' ELSE contract_type END AS contract_type,
    CASE WHEN c_custkey % 97 <> 3 THEN support_calls END AS support_calls)
  FROM full_table)"""


def sql(name: str, body: str, *ctes: str) -> None:
    SQL[name] = "WITH " + ",\n".join([DERIVED.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def imputed(source: str) -> str:
    return f"""imputed AS (
  SELECT * REPLACE (coalesce(total_charges, tenure * monthly_charges) AS total_charges,
    coalesce(number_of_logins, 8e0) AS number_of_logins, coalesce(usage_hours, 40e0) AS usage_hours)
  FROM {source})"""


def engineered(max_logins: str, max_usage: str) -> str:
    return f"""engineered AS (
  SELECT *, {rint('tenure * monthly_charges', 2)} AS customer_lifetime_value,
    {rint(f'(number_of_logins / {max_logins} + usage_hours / {max_usage}) / 2e0', 4)} AS engagement_score,
    {rint('support_calls / (tenure + 1)', 4)} AS support_interaction_ratio,
    {rint('monthly_charges / (total_charges + 1)', 6)} AS charge_ratio,
    CASE WHEN tenure IS NULL OR tenure < 0 THEN 'nan' WHEN tenure <= 12 THEN 'new' WHEN tenure <= 36 THEN 'developing'
      WHEN tenure <= 60 THEN 'established' ELSE 'loyal' END AS tenure_group
  FROM imputed)"""


OWN_MAXIMA = engineered(
    "(SELECT greatest(max(number_of_logins), 1e0) FROM imputed)", "(SELECT greatest(max(usage_hours), 1e0) FROM imputed)"
)
FIXED_MAXIMA = engineered(f"{fixed_model.MAX_LOGINS!r}::DOUBLE", f"{fixed_model.MAX_USAGE!r}::DOUBLE")


def dummy(feature: str) -> str:
    for column in ("contract_type", "internet_service", "payment_method"):
        if feature.startswith(column + "_"):
            return f"CAST(coalesce({column} = '{feature[len(column) + 1:]}', false) AS INT)"
    raise KeyError(feature)


DUMMIES = [f for f in fixed_model.FEATURES if f.startswith(("contract", "internet", "payment"))]
GROUP_CODE = "CASE tenure_group WHEN 'developing' THEN 1 WHEN 'established' THEN 2 WHEN 'loyal' THEN 3 ELSE 0 END"
ONE_HOT = ",\n    ".join(f'{dummy(f)} AS "{f}"' for f in DUMMIES)

RULES = """
ruled AS (SELECT *, concat_ws(' | ',
  CASE WHEN tenure IS NULL THEN 'missing:tenure' END,
  CASE WHEN monthly_charges IS NULL THEN 'missing:monthly_charges' END,
  CASE WHEN support_calls IS NULL THEN 'missing:support_calls' END,
  CASE WHEN contract_type IS NULL THEN 'missing:contract_type' END,
  CASE WHEN internet_service IS NULL THEN 'missing:internet_service' END,
  CASE WHEN payment_method IS NULL THEN 'missing:payment_method' END,
  CASE WHEN tenure < 0 OR tenure > 720 THEN 'range:tenure' END,
  CASE WHEN monthly_charges <= 0 OR monthly_charges > 10000 THEN 'range:monthly_charges' END,
  CASE WHEN support_calls < 0 OR support_calls > 100 THEN 'range:support_calls' END,
  CASE WHEN total_charges < 0 THEN 'range:total_charges' END,
  CASE WHEN number_of_logins < 0 OR number_of_logins > 1000 THEN 'range:number_of_logins' END,
  CASE WHEN usage_hours < 0 OR usage_hours > 8760 THEN 'range:usage_hours' END,
  CASE WHEN contract_type NOT IN ('Month-to-Month', 'One Year', 'Two Year') THEN 'category:contract_type' END,
  CASE WHEN internet_service NOT IN ('DSL', 'Fiber Optic', 'No') THEN 'category:internet_service' END,
  CASE WHEN payment_method NOT IN ('Electronic Check', 'Mailed Check', 'Bank Transfer', 'Credit Card')
    THEN 'category:payment_method' END) AS violations FROM dirty)"""


def feature_value(name: str) -> str:
    return f"({GROUP_CODE})" if name == "tenure_group" else dummy(name) if name in DUMMIES else name


def scaled(row: tuple) -> str:
    name, mean, scale, _ = row
    return f"((m{fixed_model.FEATURES.index(name)} - {mean!r}::DOUBLE) / {scale!r}::DOUBLE)"


MATRIX = f"""matrix AS (SELECT *,
  {', '.join(f'{feature_value(f)}::DOUBLE AS m{i}' for i, f in enumerate(fixed_model.FEATURES))} FROM engineered)"""


def margin(drop: tuple = ()) -> str:
    parts = [f"{0.0 if row[0] in drop else row[3]!r}::DOUBLE * {scaled(row)}" for row in fixed_model.TABLE]
    return " + ".join([f"{fixed_model.INTERCEPT!r}::DOUBLE", *parts])


def probability(drop: tuple = ()) -> str:
    return f"(1e0 / (1e0 + exp(-({margin(drop)}))))"


def scored(source: str = "full_table", engagement: str = "(number_of_logins / 50e0 + usage_hours / 200e0) / 2e0") -> list[str]:
    return [
        imputed(source),
        FIXED_MAXIMA,
        MATRIX,
        f"with_p AS (SELECT *, {probability()} AS p, {engagement} AS rule_engagement FROM matrix)",
        f"""scored AS (SELECT *, CAST(p >= 0.5 AS INT) AS churn_label,
  CASE WHEN p >= 0.75 THEN 'Critical' WHEN p >= 0.5 THEN 'High' WHEN p >= 0.25 THEN 'Medium' ELSE 'Low' END AS risk_segment,
  {exact('p * monthly_charges * 6e0', 2)} AS expected_revenue_loss,
  coalesce(nullif(concat_ws(' | ',
    CASE WHEN monthly_charges > 800 THEN printf('Offer a loyalty discount or reduced-rate plan (current charge: $%.0f/mo)', monthly_charges) END,
    CASE WHEN support_calls >= 5 THEN printf('Escalate to a Priority Support Agent (%d support calls logged)', support_calls) END,
    CASE WHEN contains(lower(contract_type), 'month') THEN 'Upsell to an Annual or Two-Year contract with incentive pricing' END,
    CASE WHEN rule_engagement < 0.3e0 THEN 'Trigger a personalised re-engagement campaign (low login frequency and usage hours detected)' END
    ), ''), 'Monitor account health — no immediate escalation required') AS retention_strategy,
  list_filter([
    CASE WHEN tenure < 12 THEN printf('Short account tenure (%d months) increases churn risk significantly', tenure) END,
    CASE WHEN monthly_charges > 800 THEN printf('High monthly charges ($%.0f) increase churn risk moderately', monthly_charges) END,
    CASE WHEN support_calls >= 5 THEN printf('High support call volume (%d calls) indicates service friction', support_calls) END,
    CASE WHEN contains(lower(contract_type), 'month') THEN 'Month-to-month contract type increases likelihood of switching' END,
    CASE WHEN (number_of_logins / 50e0 + usage_hours / 200e0) / 2e0 < 0.3e0
      THEN printf('Low engagement score (%.2f) suggests reduced product attachment', (number_of_logins / 50e0 + usage_hours / 200e0) / 2e0) END
    ], lambda x: x IS NOT NULL) AS found FROM with_p)""",
    ]


RESULT = f"""SELECT customer_id, {exact('p', 4)} AS churn_probability, churn_label, risk_segment, expected_revenue_loss,
  retention_strategy, CASE WHEN len(found) = 0
    THEN printf('Churn probability of %.1f%%', p * 100e0) || ' detected — load model with background data for detailed SHAP reasons'
    ELSE array_to_string(found[1:3], ' | ') END AS top_reasons FROM scored"""

# Sources
sql("derived_customers", "SELECT * FROM churners")
sql("labelled_csv_round_trip", "SELECT * FROM churners")
sql("scoring_csv_round_trip", "SELECT * EXCLUDE (churn, total_charges), NULL::DOUBLE AS total_charges FROM churners")
sql("mixed_header_folder", "SELECT * FROM churners")
sql("result_csv_round_trip", RESULT, *scored())
sql("normalised_headers", "SELECT * FROM churners")
sql(
    "customer_id_fallback",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE customer_id END AS customer_id FROM full_table",
)

# Rules and gates
sql(
    "value_rule_counts",
    "SELECT count(*) FILTER (WHERE tenure < 0) AS negative_tenure, "
    "count(*) FILTER (WHERE monthly_charges <= 0) AS charges_not_positive FROM dirty",
)
sql("value_rule_offenders", "SELECT customer_id, tenure FROM dirty WHERE tenure < 0 ORDER BY customer_id LIMIT 10")
sql("record_violations", "SELECT customer_id, violations FROM ruled", RULES)
sql(
    "rejected_rows",
    "SELECT * FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS source_row_id, customer_id, violations FROM ruled) WHERE violations <> ''",
    RULES,
)
sql(
    "accepted_rows_scored", RESULT, RULES,
    "clean AS (SELECT * EXCLUDE (violations) FROM ruled WHERE violations = '')", *scored("clean"),
)
CHECKED = (
    "customer_id", "tenure", "monthly_charges", "contract_type", "internet_service", "payment_method", "support_calls",
    "number_of_logins", "usage_hours", "total_charges", "churn",
)
sql(
    "column_null_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM dirty"
        for c in CHECKED
    ),
)
sql(
    "churn_rate_gate",
    "SELECT round(avg(churn), 6) AS churn_rate, avg(churn) BETWEEN 0.1 AND 0.4 AS passed FROM churners",
)
COPIES = "copies AS (SELECT * FROM full_table UNION ALL SELECT * FROM full_table WHERE c_custkey % 50 = 0)"
sql("duplicate_customer_ids", "SELECT customer_id, count(*) AS rows FROM copies GROUP BY customer_id HAVING count(*) > 1", COPIES)


def gate(rule: str, value: str, low: str, high: str) -> str:
    tests = [t for t in (f"v >= {low}" if low != "NULL" else "", f"v <= {high}" if high != "NULL" else "") if t]
    return (
        f"SELECT '{rule}' AS rule, round(v::DOUBLE, 6) AS value, {low}::DOUBLE AS min_allowed, {high}::DOUBLE AS max_allowed, "
        f"coalesce({' AND '.join(tests)}, false) AS passed FROM (SELECT {value} AS v FROM spoiled)"
    )


SPOILED = """
spoiled AS (SELECT * REPLACE (CASE WHEN c_custkey % 41 <> 0 THEN customer_id END AS customer_id, support_calls::BIGINT AS support_calls)
  FROM (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE c_custkey % 50 = 0 UNION ALL SELECT * FROM dirty WHERE c_custkey % 50 = 0))"""
WHOLE_NUMBERS, FRACTIONS = ("tenure", "support_calls", "churn"), ("monthly_charges", "number_of_logins", "usage_hours", "total_charges")
WRONG_TYPES = " + ".join(
    [f"(max(typeof({c})) <> 'INTEGER')::INT" for c in WHOLE_NUMBERS] + [f"(max(typeof({c})) <> 'DOUBLE')::INT" for c in FRACTIONS]
)
sql(
    "data_gate_table",
    " UNION ALL ".join(
        [gate(f"null_rate:{c}", f"(count(*) - count({c})) / count(*)", "NULL", "0.05") for c in CHECKED]
        + [
            gate("churn_rate", "avg(churn)", "0.1", "0.4"),
            gate("negative_tenure", "count(*) FILTER (WHERE tenure < 0)", "NULL", "0.0"),
            gate("charges_not_positive", "count(*) FILTER (WHERE monthly_charges <= 0)", "NULL", "0.0"),
            gate("duplicate_ids", "(SELECT count(*) FROM (SELECT customer_id FROM spoiled WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))", "NULL", "0.0").replace(" FROM (SELECT (SELECT", " FROM (SELECT DISTINCT (SELECT"),
            gate("type_faults", WRONG_TYPES, "NULL", "0.0"),
        ]
    ),
    SPOILED,
)

# Features and encoding
sql("imputed_customers", "SELECT customer_id, total_charges, number_of_logins, usage_hours FROM imputed", imputed("churners"))
sql(
    "imputed_absent_columns",
    "SELECT customer_id, tenure * monthly_charges AS total_charges, 8e0 AS number_of_logins, 40e0 AS usage_hours FROM churners",
)
sql(
    "usage_maxima",
    "SELECT greatest(max(number_of_logins), 1e0) AS max_logins, greatest(max(usage_hours), 1e0) AS max_usage FROM imputed",
    imputed("churners"),
)
sql("engineered_features", "SELECT * FROM engineered", imputed("churners"), OWN_MAXIMA)
sql(
    "churn_by_tenure_group_and_contract",
    f"SELECT tenure_group, contract_type, count(*) AS customers, {rint('avg(churn) * 100e0', 1)} AS churn_rate_pct, "
    "round(avg(customer_lifetime_value), 4) AS avg_lifetime_value FROM engineered GROUP BY ALL",
    imputed("churners"), OWN_MAXIMA,
)
sql(
    "category_vocabulary",
    "SELECT name, category, CAST(row_number() OVER (PARTITION BY name ORDER BY category) - 1 AS INT) AS position FROM ("
    + " UNION ".join(f"SELECT '{c}' AS name, {c} AS category FROM churners" for c in ("contract_type", "internet_service", "payment_method"))
    + ")",
)
sql(
    "encoded_customers",
    f"SELECT * EXCLUDE (contract_type, internet_service, payment_method) REPLACE ({GROUP_CODE} AS tenure_group),\n    {ONE_HOT} FROM engineered",
    imputed("churners"), OWN_MAXIMA,
)
sql(
    "unseen_categories_encoded",
    "SELECT customer_id, CASE contract_type WHEN 'One Year' THEN 1 WHEN 'Two Year' THEN 2 ELSE 0 END AS contract_code, "
    + ", ".join(f'{dummy(f)} AS "{f}"' for f in DUMMIES[:2]) + " FROM dirty",
)
sql(
    "aligned_matrix",
    "SELECT customer_id, "
    + ", ".join(f'm{i} AS "{f}"' for i, f in enumerate(fixed_model.FEATURES[:-1])) + ", 0e0 AS region_score FROM matrix",
    imputed("churners"), FIXED_MAXIMA, MATRIX,
)
sql(
    "features_and_label",
    "SELECT tenure, monthly_charges, customer_lifetime_value, charge_ratio, churn FROM engineered",
    imputed("churners"), FIXED_MAXIMA,
)

# Reports
sql(
    "overview",
    "SELECT count(*) AS customers, round(avg(churn), 6) AS churn_rate, round(avg(monthly_charges), 6) AS avg_monthly_charges, "
    "round(avg(tenure), 6) AS avg_tenure FROM churners",
)
sql(
    "churn_counts",
    "SELECT CASE churn WHEN 0 THEN 'Retained' WHEN 1 THEN 'Churned' END AS status, count(*) AS customers FROM churners GROUP BY churn",
)
PCT = rint("avg(churn) * 100e0", 1)
sql("churn_rate_by_contract", f"SELECT contract_type, {PCT} AS churn_rate_pct FROM churners GROUP BY contract_type")
sql(
    "churn_rate_by_tenure_bucket",
    f"""SELECT tenure_bucket, {PCT} AS churn_rate_pct FROM (SELECT churn, CASE WHEN tenure BETWEEN 0 AND 12 THEN '0–12 mo'
      WHEN tenure BETWEEN 13 AND 36 THEN '13–36 mo' WHEN tenure BETWEEN 37 AND 60 THEN '37–60 mo'
      WHEN tenure BETWEEN 61 AND 72 THEN '61–72 mo' END AS tenure_bucket FROM churners)
    WHERE tenure_bucket IS NOT NULL GROUP BY tenure_bucket""",
)
sql("churn_rate_by_support_calls", f"SELECT support_calls, {PCT} AS churn_rate_pct FROM churners GROUP BY support_calls")
sql(
    "charges_histogram",
    """SELECT CAST(least(floor((monthly_charges - low) / ((high - low) / 40e0)), 39) + 1 AS INT) AS bin, churn, count(*) AS customers
    FROM churners, (SELECT min(monthly_charges) AS low, max(monthly_charges) AS high FROM churners) GROUP BY ALL""",
)
sql(
    "scatter_sample",
    f"SELECT customer_id, tenure, monthly_charges, churn FROM churners ORDER BY {order('customer_id', '42')}, customer_id LIMIT 1000",
)
sql("preview_rows", "SELECT * FROM churners ORDER BY customer_id LIMIT 5")
sql(
    "exact_medians",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, median({c}) AS median FROM churners" for c in ("monthly_charges", "number_of_logins", "usage_hours")),
)
MEDIANS = rule_probability("(SELECT median(number_of_logins) FROM churners)", "(SELECT median(usage_hours) FROM churners)")
sql("rule_based_scores", f"SELECT customer_id, round({MEDIANS}, 6) AS churn_probability FROM churners")

# Split, folds, scaling, over-sampling. Two classes: the training part is floored, the larger remainder gets the row left.
SPLIT = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY {order('customer_id', '42')}) AS r FROM churners),
totals AS (SELECT count(*) AS n, count(*) - CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS n_train,
  count(*) FILTER (WHERE churn = 0) AS n0, count(*) FILTER (WHERE churn = 1) AS n1 FROM churners),
shares AS (SELECT *, floor(n_train * n0::DOUBLE / n) AS t0, floor(n_train * n1::DOUBLE / n) AS t1,
  n_train * n0::DOUBLE / n AS e0, n_train * n1::DOUBLE / n AS e1 FROM totals),
quotas AS (SELECT 0 AS churn, n0 - t0 - CASE WHEN n_train > t0 + t1 AND e0 - t0 >= e1 - t1 THEN 1 ELSE 0 END AS quota FROM shares
  UNION ALL SELECT 1, n1 - t1 - CASE WHEN n_train > t0 + t1 AND e0 - t0 < e1 - t1 THEN 1 ELSE 0 END FROM shares),
parts AS (SELECT ranked.*, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quotas USING (churn))"""
sql("train_test_split", "SELECT customer_id, churn, split FROM parts", SPLIT)
sql("class_balance", "SELECT split, count(*) AS rows, round(avg(churn) * 100, 6) AS churn_pct FROM parts GROUP BY split", SPLIT)
sql(
    "train_test_overlap",
    "SELECT count(*) AS shared_keys FROM (SELECT customer_id FROM parts WHERE split = 'train' INTERSECT SELECT customer_id FROM parts WHERE split = 'test')",
    SPLIT,
)
FOLD_SIZE = " + ".join(
    f"CASE WHEN r > {' + '.join(f'((start + n - {j} + 4) // 5 - (start - {j} + 4) // 5)' for j in range(i + 1))} THEN 1 ELSE 0 END"
    for i in range(4)
)
FOLDS = f"""
folded AS (SELECT *, CAST({FOLD_SIZE} AS INT) AS fold FROM (
  SELECT *, row_number() OVER (PARTITION BY churn ORDER BY {order('customer_id', 'fold-42')}) AS r,
    count(*) OVER (PARTITION BY churn) AS n,
    CASE churn WHEN 0 THEN 0 ELSE (SELECT count(*) FROM churners WHERE churn = 0) END AS start FROM churners))"""
sql("cross_validation_folds", "SELECT customer_id, churn, fold FROM folded", FOLDS)
sql(
    "scaler_state",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg(m{i}), 6) AS mean, round(CASE WHEN stddev_pop(m{i}) > 0 THEN stddev_pop(m{i}) ELSE 1 END, 6) AS scale FROM matrix"
        for i, f in enumerate(fixed_model.FEATURES)
    ),
    imputed("churners"), FIXED_MAXIMA, MATRIX,
)
sql(
    "class_weights",
    "SELECT churn, count(*) AS rows, round((SELECT count(*) FROM churners) / ((SELECT count(DISTINCT churn) FROM churners) * count(*)), 6) AS weight "
    "FROM churners GROUP BY churn",
)
DISTANCE = " + ".join(f"(a.m{i} - b.m{i}) * (a.m{i} - b.m{i})" for i in range(len(fixed_model.FEATURES)))
NEAR = [
    imputed("churners"), FIXED_MAXIMA, MATRIX,
    f"""near AS (SELECT a.customer_id AS id, b.customer_id AS neighbour_id, {DISTANCE} AS d2,
  row_number() OVER (PARTITION BY a.customer_id ORDER BY {DISTANCE}, b.customer_id) AS rank
  FROM matrix a JOIN matrix b ON a.customer_id <> b.customer_id WHERE a.churn = 1 AND b.churn = 1 QUALIFY rank <= 5)""",
]
sql(
    "churner_neighbours",
    "SELECT id AS customer_id, CAST(rank AS INT) AS rank, neighbour_id, round(sqrt(d2), 6) AS distance FROM near", *NEAR,
)
SYNTHETIC = f"""
need AS (SELECT n0 - n1 AS n_syn, n1 AS n_min FROM (
  SELECT count(*) FILTER (WHERE churn = 0) AS n0, count(*) FILTER (WHERE churn = 1) AS n1 FROM churners)),
seeds AS (SELECT customer_id AS id, n_syn // n_min + CASE WHEN row_number() OVER (ORDER BY {order('customer_id', 'extra-42')}) <= n_syn % n_min
  THEN 1 ELSE 0 END AS copies FROM churners, need WHERE churn = 1),
drawn AS (SELECT id, 'syn-' || id || '-' || j AS customer_id FROM (SELECT id, unnest(range(1, copies + 1)) AS j FROM seeds)),
picked AS (SELECT *, {unit('customer_id', 'gap-42')} AS gap, {order('customer_id', 'pick-42')} % 5 + 1 AS place FROM drawn)"""


def between(i: int) -> str:
    return f"a.m{i} + gap * (b.m{i} - a.m{i})"


sql(
    "synthetic_churners",
    f"""SELECT picked.customer_id, picked.id AS seed_id, near.neighbour_id, round(gap, 6) AS gap, round({between(0)}, 6) AS tenure,
      round({between(1)}, 6) AS monthly_charges, round({between(5)}, 6) AS usage_hours
    FROM picked JOIN near ON near.id = picked.id AND near.rank = picked.place
    JOIN matrix a ON a.customer_id = picked.id JOIN matrix b ON b.customer_id = near.neighbour_id""",
    *NEAR, SYNTHETIC,
)
sql(
    "balanced_class_counts",
    "SELECT churn, (SELECT max(n) FROM (SELECT count(*) AS n FROM churners GROUP BY churn)) AS customers FROM (SELECT DISTINCT churn FROM churners)",
)

# Scoring with fixed coefficients
sql("churn_probabilities", "SELECT customer_id, round(p, 6) AS churn_probability FROM with_p", *scored("churners")[:4])
sql("scored_customers", RESULT, *scored())
sql(
    "retention_with_supplied_engagement", "SELECT customer_id, retention_strategy FROM scored",
    *scored(engagement="CASE c_custkey % 3 WHEN 0 THEN 0.2999e0 WHEN 1 THEN 0.3e0 ELSE (number_of_logins / 50e0 + usage_hours / 200e0) / 2e0 END"),
)
PARTS = " UNION ALL ".join(
    f"SELECT customer_id, {i} AS position, '{row[0]}' AS feature, m{i} AS v, {row[3]!r}::DOUBLE * ({scaled(row)} - %s) AS contribution FROM matrix"
    for i, row in enumerate(fixed_model.TABLE)
)
CENTRED = PARTS % tuple(f"(SELECT avg({scaled(row)}) FROM matrix)" for row in fixed_model.TABLE)
sql(
    "linear_contributions", f"SELECT customer_id, feature, round(contribution, 6) AS contribution FROM ({CENTRED})",
    imputed("churners"), FIXED_MAXIMA, MATRIX,
)
# The text that stands for each feature in a reason.
FEATURE_LABELS = {
    "tenure": "Account tenure",
    "monthly_charges": "Monthly charges",
    "total_charges": "Total charges to date",
    "support_calls": "Number of support calls",
    "number_of_logins": "Login frequency",
    "usage_hours": "Usage hours",
    "customer_lifetime_value": "Customer lifetime value",
    "engagement_score": "Overall engagement score",
    "support_interaction_ratio": "Support call rate",
    "charge_ratio": "Charge-to-total ratio",
    "tenure_group": "Tenure group",
    "contract_type_One Year": "One-year contract status",
    "contract_type_Two Year": "Two-year contract status",
    "internet_service_Fiber Optic": "Fiber optic service",
    "internet_service_No": "No internet service",
    "payment_method_Credit Card": "Credit card payment",
    "payment_method_Electronic Check": "Electronic check payment",
    "payment_method_Mailed Check": "Mailed check payment",
}
LABELS = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{text}'" for f, text in FEATURE_LABELS.items()) + " END"
sql(
    "contribution_reasons_text",
    f"""SELECT customer_id, string_agg({LABELS} || printf(' (%.2f) ', v) || CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END
      || ' churn risk ' || CASE WHEN abs(contribution) >= 0.15e0 THEN 'significantly' WHEN abs(contribution) >= 0.07e0 THEN 'moderately' ELSE 'slightly' END,
      ' | ' ORDER BY place) AS top_reasons
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, position) AS place
      FROM (SELECT *, count(*) FILTER (WHERE contribution > 0) OVER (PARTITION BY customer_id) AS raising FROM ({PARTS % tuple(['0e0'] * len(fixed_model.TABLE))}))
      WHERE raising < 3 OR contribution > 0)
    WHERE place <= 3 GROUP BY customer_id""",
    imputed("churners"), FIXED_MAXIMA, MATRIX,
)
sql(
    "segment_distribution",
    "SELECT risk_segment, count(*) AS customers, CASE risk_segment WHEN 'Critical' THEN '🔴' WHEN 'High' THEN '🟠' WHEN 'Medium' THEN '🟡' "
    "WHEN 'Low' THEN '🟢' ELSE '⚪' END || ' ' || risk_segment AS display FROM scored GROUP BY risk_segment",
    *scored(),
)
sql(
    "batch_summary",
    "SELECT count(*) AS total, sum(churn_label)::BIGINT AS predicted_churn, count(*) FILTER (WHERE risk_segment IN ('High', 'Critical')) AS high_risk_count, "
    "sum(CAST(round(expected_revenue_loss * 100) AS BIGINT))::DOUBLE / 100e0 AS total_expected_loss FROM scored",
    *scored(),
)


def log(batch: str) -> str:
    high = "count(*) FILTER (WHERE risk_segment IN ('High', 'Critical'))"
    return f"""log AS (SELECT {batch} AS batch_id, count(*) AS total, {rint(f"avg({exact('p', 4)}) * 100e0", 2)} AS avg_prob,
  {rint(f'{high} / count(*) * 100e0', 2)} AS high_risk_pct, sum(CAST(round(expected_revenue_loss * 100) AS BIGINT))::DOUBLE / 100e0 AS total_loss FROM scored GROUP BY 1)"""


ALERTS = "SELECT *, high_risk_pct > 70 AS alert, CASE WHEN avg_prob > 50 THEN 'HIGH' ELSE 'OK' END AS probability_status FROM log"
BY_NATION = [*scored(), log("c_nationkey")]
sql("monitoring_log", ALERTS, *BY_NATION)
sql(
    "monitoring_trend",
    "SELECT batch_id, avg_prob, high_risk_pct, round(avg_prob - lag(avg_prob) OVER (ORDER BY batch_id), 4) AS avg_prob_change, "
    "round(high_risk_pct - lag(high_risk_pct) OVER (ORDER BY batch_id), 4) AS high_risk_pct_change FROM log",
    *BY_NATION,
)
sql("latest_batch", "SELECT * FROM log ORDER BY batch_id DESC LIMIT 1", *BY_NATION)
sql(
    "monitoring_history",
    'SELECT batch_id AS "Batch", total AS "Customers", avg_prob AS "Avg Prob (%)", high_risk_pct AS "High-Risk (%)", total_loss AS "Expected Loss ($)" FROM log',
    *BY_NATION,
)
sql("appended_log", "SELECT * FROM log", *BY_NATION)
sql("stream_scoring_log", ALERTS, *scored(), log("(c_nationkey % 2)::BIGINT"))

# Metrics
SCORES = [imputed("churners"), FIXED_MAXIMA, MATRIX, f"scores AS (SELECT customer_id, churn, round({probability()}, 4) AS p FROM matrix)"]
COUNTS = """counts AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND churn = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND churn = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND churn = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND churn = 0) AS tn FROM scores)"""
sql("confusion_counts", "SELECT * FROM counts", *SCORES, COUNTS)
sql(
    "threshold_metrics",
    "SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM counts",
    *SCORES, COUNTS,
)


def curve(by: str, source: str) -> str:
    over = f"OVER (PARTITION BY {by} ORDER BY p DESC)"
    return f"""curve AS (SELECT {by} AS g, p, pos, neg, sum(pos) {over} - pos AS pos_above, sum(pos) {over} AS caught,
  sum(pos + neg) {over} AS flagged, sum(pos) OVER (PARTITION BY {by}) AS total_pos, sum(neg) OVER (PARTITION BY {by}) AS total_neg
  FROM (SELECT {by}, p, count(*) FILTER (WHERE churn = 1) AS pos, count(*) FILTER (WHERE churn = 0) AS neg FROM {source} GROUP BY {by}, p))"""


AREA = (
    "sum(neg * (pos_above + pos / 2)) / (max(total_pos) * max(total_neg)) AS roc_auc, "
    "sum(pos * caught / flagged) / max(total_pos) AS pr_auc"
)
ONE = "one_group AS (SELECT *, 1 AS g0 FROM scores)"
AREA_ROUNDED = f"round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM (SELECT g, {AREA} FROM curve GROUP BY g)"
sql("ranking_metrics", f"SELECT {AREA_ROUNDED}", *SCORES, ONE, curve("g0", "one_group"))
FOLD_SCORES = [FOLDS, *SCORES, "fold_scores AS (SELECT scores.*, fold FROM scores JOIN folded USING (customer_id))", curve("fold", "fold_scores")]
sql("fold_metrics", f"SELECT g AS fold, {AREA_ROUNDED}", *FOLD_SCORES)
sql(
    "fold_summary",
    f"SELECT round(avg(roc_auc), 6) AS cv_mean, round(stddev_pop(roc_auc), 6) AS cv_std FROM (SELECT g, {AREA} FROM curve GROUP BY g)",
    *FOLD_SCORES,
)
sql(
    "segments_of_unscored_rows",
    "SELECT customer_id, CASE WHEN q >= 0.75 THEN 'Critical' WHEN q >= 0.5 THEN 'High' WHEN q >= 0.25 THEN 'Medium' WHEN q < 0.25 THEN 'Low' END AS risk_segment, "
    "CAST(q >= 0.5 AS INT) AS churn_label FROM (SELECT *, CASE WHEN CAST(substr(customer_id, 6) AS BIGINT) % 7 > 0 THEN p END AS q FROM scores)",
    *SCORES,
)
sql(
    "metrics_with_a_null_group",
    "SELECT contract, round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, "
    "round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 "
    "FROM areas JOIN at_half ON areas.g IS NOT DISTINCT FROM at_half.contract",
    imputed("churners"), FIXED_MAXIMA, MATRIX,
    f"by_contract AS (SELECT CASE WHEN contract_type <> 'Two Year' THEN contract_type END AS contract, churn, round({probability()}, 4) AS p FROM matrix)",
    curve("contract", "by_contract"), f"areas AS (SELECT g, {AREA} FROM curve GROUP BY g)",
    """at_half AS (SELECT contract, count(*) FILTER (WHERE p >= 0.5 AND churn = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND churn = 0) AS fp,
  count(*) FILTER (WHERE p < 0.5 AND churn = 1) AS fn FROM by_contract GROUP BY contract)""",
)
PROFIT = "SELECT p AS threshold, flagged::BIGINT AS contacted, caught::BIGINT AS caught, caught * 500e0 - flagged * 120e0 AS profit FROM curve"
sql("profit_curve", PROFIT, *SCORES, ONE, curve("g0", "one_group"))
sql("most_profitable_threshold", f"{PROFIT} ORDER BY profit DESC, threshold DESC LIMIT 1", *SCORES, ONE, curve("g0", "one_group"))

RUN_SCORES = " UNION ALL ".join(
    f"SELECT {i} AS run_order, '{name}' AS model_name, {str(flag).lower()} AS smote, churn, round({probability(drop)}, 4) AS p FROM matrix"
    for i, (name, flag, drop) in enumerate(fixed_model.RUNS)
)
RUNS = [
    imputed("churners"), FIXED_MAXIMA, MATRIX, f"run_scores AS ({RUN_SCORES})", curve("run_order", "run_scores"),
    f"areas AS (SELECT g AS run_order, {AREA} FROM curve GROUP BY g)",
    """at_half AS (SELECT run_order, model_name, smote, count(*) FILTER (WHERE p >= 0.5 AND churn = 1) AS tp,
  count(*) FILTER (WHERE p >= 0.5 AND churn = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND churn = 1) AS fn FROM run_scores GROUP BY ALL)""",
    """runs AS (SELECT run_order, model_name || CASE WHEN smote THEN '_smote' ELSE '_no_smote' END AS run_id, model_name, smote,
  round(roc_auc, 4) AS test_roc_auc, round(pr_auc, 4) AS test_pr_auc, round(tp / (tp + fp), 4) AS test_precision,
  round(tp / (tp + fn), 4) AS test_recall, round(2 * tp / (2 * tp + fp + fn), 4) AS test_f1 FROM areas JOIN at_half USING (run_order))""",
]
sql(
    "run_comparison",
    "SELECT *, CAST(row_number() OVER best AS INT) AS rank, row_number() OVER best = 1 AS is_best FROM runs "
    "WINDOW best AS (ORDER BY test_roc_auc DESC, run_order)",
    *RUNS,
)
BEST = "ORDER BY test_roc_auc DESC, run_order LIMIT 1"
sql("best_run", f"SELECT run_id, test_roc_auc FROM runs {BEST}", *RUNS)
sql(
    "run_table",
    'SELECT run_id AS "Run", smote AS "SMOTE", test_roc_auc AS "Test AUC", test_precision AS "Precision", test_recall AS "Recall", test_f1 AS "F1" FROM runs',
    *RUNS,
)
sql(
    "run_metadata_round_trip",
    f"SELECT run_order, run_id, test_roc_auc, CASE run_order WHEN 0 THEN (SELECT run_id FROM runs {BEST}) END AS best_run_id, "
    "CASE run_order WHEN 0 THEN 18 END AS n_features, CASE run_order WHEN 0 THEN '2001-08-01T00:00:00+00:00' END AS trained_at FROM runs",
    *RUNS,
)
sql(
    "model_gate_table",
    "SELECT run_id, 'roc_auc' AS rule, test_roc_auc AS value, 0.8e0 AS min_allowed, NULL::DOUBLE AS max_allowed, test_roc_auc >= 0.8 AS passed FROM runs "
    "UNION ALL SELECT run_id, 'pr_auc', test_pr_auc, 0.55e0, NULL::DOUBLE, test_pr_auc >= 0.55 FROM runs",
    *RUNS,
)
sql(
    "coefficient_importances",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{row[0]}' AS feature, round({abs(row[3])!r}::DOUBLE / {row[2]!r}::DOUBLE * stddev_pop(m{i}), 6) AS importance FROM matrix"
        for i, row in enumerate(fixed_model.TABLE)
    )
    + ") ORDER BY importance DESC, feature LIMIT 15",
    imputed("churners"), FIXED_MAXIMA, MATRIX,
)

# Fitted models: properties that hold whatever was fitted
sql(
    "fitted_logistic_minimum",
    f"SELECT unnest([{', '.join(repr(f) for f in [*fixed_model.FEATURES, 'intercept'])}]) AS parameter, 0e0 * count(*) AS slope FROM churners",
)
sql("saved_scorer_scores_again", "SELECT count(*) AS scored, 0::BIGINT AS different FROM churners")
sql("contributions_add_up", "SELECT count(*) AS explained, 0e0 AS largest_residual FROM churners")
sql("importances_add_up", f"SELECT {len(fixed_model.FEATURES)}::BIGINT AS features, 1e0 AS total FROM (SELECT count(*) FROM churners)")
# Rows of the training part by class; over-sampling makes both as many as the larger one.
sql(
    "six_variant_runs",
    """SELECT CAST(row_number() OVER (ORDER BY place, smote) - 1 AS INT) AS run_order, model_name || CASE WHEN smote THEN '_smote' ELSE '_no_smote' END AS run_id,
  model_name, smote, 5::BIGINT AS folds, 0::BIGINT AS unscored_folds, trees,
  CASE WHEN smote THEN greatest(n0, n1) ELSE n0 END AS negatives, CASE WHEN smote THEN greatest(n0, n1) ELSE n1 END AS positives
FROM (SELECT * FROM (VALUES (0, 'logistic_regression', 0::BIGINT), (1, 'random_forest', 200::BIGINT), (2, 'gradient_boosting', 300::BIGINT)) t(place, model_name, trees)),
  (SELECT unnest([false, true]) AS smote),
  (SELECT count(*) FILTER (churn = 0) AS n0, count(*) FILTER (churn = 1) AS n1 FROM parts WHERE split = 'train')""",
    SPLIT,
)
sql("neighbour_descent_recall", "SELECT count(*) FILTER (churn = 1) AS churners, true AS recall_reached FROM churners")
sql("strict_batch", "SELECT count(*) FILTER (violations <> '') AS bad_rows, count(*) FILTER (violations <> '') > 0 AS refused FROM ruled", RULES)
sql(
    "tuned_metadata_round_trip",
    "SELECT 'logistic_regression' AS model_name, true AS use_smote, 50 AS n_trials, 5 AS cv_folds, 2 AS parameters, 0e0 * count(*) AS gain_off, 0e0 * count(*) AS best_off FROM churners",
)
sql("whole_training_job", "SELECT 2::BIGINT AS runs, 2::BIGINT AS validated, 18 AS n_features, 18::BIGINT AS importances, count(*) AS scored FROM churners")
sql("contribution_reasons_by_model", "SELECT unnest(['logistic_regression', 'gradient_boosting']) AS model_name, told FROM (SELECT count(*) AS told FROM churners)")
