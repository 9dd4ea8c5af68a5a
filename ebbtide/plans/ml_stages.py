"""The encoder and the classifiers as stages of an `ml.Pipeline`, so that a fitted object travels as one folder.

    fitted = customer_pipeline("gradient_boosting", smote=True).fit(training_rows)
    fitted.write().save(path); PipelineModel.load(path).transform(new_rows)

The classifier stage over-samples inside ``fit`` only: neither ``transform`` of its model nor the stages before it see a synthetic
row. Both stages keep the columns they are given; the encoder marks the feature columns it makes in their metadata, and
the classifier takes all marked ones unless told which.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from ebbtide.operators.classifiers import FittedClassifier, build_variant, fit_classifier, load_classifier, save_classifier
from ebbtide.operators.encoding import EncoderState, fit_encoder, impute
from ebbtide.operators.smote import oversample
from ebbtide.plans.scoring import with_feature_columns
from ebbtide.session import cut_lineage
from ebbtide.sources.schema import ID, LABEL, SchemaError

MARK = {"ebbtide_feature": True}


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage._save_state(self.sparkSession, f"{path}/state")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._load_state(self.sparkSession, f"{path}/state")
        return stage


class _Stored(MLWritable, MLReadable):
    """A stage that is written with its fitted state; stages without one have none to write."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _save_state(self, spark, path: str) -> None:
        pass

    def _load_state(self, spark, path: str) -> None:
        pass


class CustomerEncoder(_Stored, Estimator):
    """Learns maxima and vocabulary from the rows it is fitted on."""

    def _fit(self, dataset: DataFrame) -> "CustomerEncoderModel":
        return CustomerEncoderModel(fit_encoder(impute(dataset)))


class CustomerEncoderModel(_Stored, Model):
    """Adds the feature columns and marks them."""

    def __init__(self, state: EncoderState | None = None):
        super().__init__()
        self.state = state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = with_feature_columns(dataset, self.state, self.state.feature_names)
        for name in self.state.feature_names:
            made = made.withMetadata(name, MARK)
        return made

    def _save_state(self, spark, path: str) -> None:
        self.state.save(spark, path)

    def _load_state(self, spark, path: str) -> None:
        self.state = EncoderState.load(spark, path)


class _ChurnParams(Params):
    modelName = Param(Params._dummy(), "modelName", "logistic_regression, random_forest or gradient_boosting", TypeConverters.toString)
    smote = Param(Params._dummy(), "smote", "over-sample the minority in fit", TypeConverters.toBoolean)
    modelParams = Param(Params._dummy(), "modelParams", "JSON of the parameters that differ from the defaults", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature columns; the marked ones if empty", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "binary label", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id, of which all draws are made", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "probability of class 1", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(modelName="logistic_regression", smote=False, modelParams="{}", features=[], labelCol=LABEL, idCol=ID, outputCol="churn_probability", seed=42)


class ChurnClassifier(_Stored, _ChurnParams, Estimator):
    """Fits a variant; with ``smote`` on the given rows and synthetic ones."""

    @keyword_only
    def __init__(self, *, modelName=None, smote=None, modelParams=None, features=None, labelCol=None, idCol=None, outputCol=None, seed=None):
        super().__init__()
        self._set(**{name: value for name, value in self._input_kwargs.items() if value is not None})

    def _fit(self, dataset: DataFrame) -> "ChurnClassifierModel":
        given = {param.name: self.getOrDefault(param) for param in self.params}
        features = given["features"] or [f.name for f in dataset.schema.fields if f.metadata.get("ebbtide_feature")]
        if not features:
            raise SchemaError("no feature columns are given or marked")
        variant = build_variant(given["modelName"], given["smote"], given["seed"], **json.loads(given["modelParams"]))
        label, key = given["labelCol"], given["idCol"]
        rows = cut_lineage(dataset.select(key, *[dataset[f"`{name}`"].cast("double").alias(name) for name in features], label))
        if given["smote"]:
            rows = oversample(rows, features, seed=given["seed"], key=key, label=label)
        return self._copyValues(ChurnClassifierModel(fit_classifier(rows, features, variant, label, key)))


class ChurnClassifierModel(_Stored, _ChurnParams, Model):
    """Adds the probability; every row comes out once, whatever the rows of the fit were."""

    def __init__(self, fitted: FittedClassifier | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getOrDefault(self.outputCol))

    def _save_state(self, spark, path: str) -> None:
        save_classifier(spark, self.fitted, path)

    def _load_state(self, spark, path: str) -> None:
        self.fitted = load_classifier(spark, path)


def customer_pipeline(model: str, smote: bool = False, seed: int = 42, **params) -> Pipeline:
    """Encoder and classifier for raw customer rows."""
    build_variant(model, smote, seed, **params)  # refuses unknown names and parameters before any job
    return Pipeline(stages=[CustomerEncoder(), ChurnClassifier(modelName=model, smote=smote, seed=seed, modelParams=json.dumps(params))])
