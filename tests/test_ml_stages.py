"""A fitted pipeline scores as its parts do, saved and loaded too, and over-samples in fit only."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ebbtide.plans import ml_stages
from checks.derived import training_table
from ebbtide.sources.schema import SchemaError

SMALL = {"logistic_regression": {}, "random_forest": {"n_estimators": 5, "max_depth": 4}, "gradient_boosting": {"n_estimators": 5, "max_depth": 3}}


@pytest.fixture(scope="module")
def customers(spark):
    return training_table(spark, "/root/testdata/sf0.01").cache()


@pytest.mark.parametrize("model", SMALL)
@pytest.mark.parametrize("smote", [False, True])
def test_loaded_pipeline_scores_as_before(spark, customers, tmp_path, model, smote):
    pipeline = ml_stages.customer_pipeline(model, smote, **SMALL[model])
    pipeline.write().save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(customers)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    new = customers.drop("churn", "total_charges")
    a, b = (m.transform(new).select("customer_id", "churn_probability") for m in (fitted, loaded))
    assert a.count() == new.count() == 1500 and a.exceptAll(b).count() == 0
    assert loaded.stages[-1].uid == fitted.stages[-1].uid and loaded.stages[-1].fitted.variant == fitted.stages[-1].fitted.variant
    assert loaded.stages[-1].fitted.variant.steps[0] == ("smote" if smote else fitted.stages[-1].fitted.variant.steps[0])


def test_over_sampling_happens_in_fit_only(customers, monkeypatch):
    seen = []
    plain = ml_stages.fit_classifier
    monkeypatch.setattr(ml_stages, "fit_classifier", lambda rows, *rest: (seen.append(rows.groupBy("churn").count().collect()), plain(rows, *rest))[1])
    fitted = ml_stages.customer_pipeline("logistic_regression", True).fit(customers)
    assert len({r["count"] for r in seen[0]}) == 1
    scored = fitted.transform(customers)
    assert scored.count() == 1500 and scored.where(F.col("customer_id").startswith("syn-")).count() == 0
    assert set(customers.columns) <= set(scored.columns)


def test_wrong_parts_are_refused(customers):
    with pytest.raises(ValueError, match="unknown model"):
        ml_stages.customer_pipeline("svm")
    with pytest.raises(ValueError, match="no parameter"):
        ml_stages.customer_pipeline("logistic_regression", gamma=1)
    with pytest.raises(SchemaError, match="feature"):
        ml_stages.ChurnClassifier().fit(customers)
    named = ml_stages.ChurnClassifier(features=["tenure", "support_calls"], outputCol="p").fit(customers)
    assert named.transform(customers).where("p > 0 AND p < 1").count() == 1500
