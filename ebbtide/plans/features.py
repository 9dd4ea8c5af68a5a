"""The feature step as one plan, and the model matrix built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.checks import require_valid_values
from ebbtide.operators.encoding import EncoderState, align, encode, engineered, fit_encoder, impute, usage_maxima
from ebbtide.operators.selection import stratified_split
from ebbtide.sources.schema import ID, LABEL
from ebbtide.sources.tables import nan_to_null, normalise_headers, require_columns


def engineer_features(df: DataFrame, maxima: tuple[float, float] | None = None, check: bool = True) -> DataFrame:
    """Headers, required columns, value rules, imputation and the five derived columns.

    Without ``maxima`` the engagement score is relative to the largest logins and usage of this very table. The check and
    the maxima come from one aggregate; without the check the maxima arrive through a scalar subquery.
    """
    df = impute(nan_to_null(require_columns(normalise_headers(df))))
    if check:
        key = next((name for name in (ID, "source_row_id") if name in df.columns), None)
        largest = [F.greatest(F.max(name), F.lit(1.0)) for name in ("number_of_logins", "usage_hours")]
        found = require_valid_values(df, key, *(largest if maxima is None else ()))
        maxima = maxima or tuple(1.0 if value is None else value for value in found)
    elif maxima is None:
        largest = usage_maxima(df).select(F.struct("max_logins", "max_usage")).scalar()
        maxima = (largest["max_logins"], largest["max_usage"])
    return engineered(df, *maxima)


@dataclass(frozen=True)
class Matrices:
    """Encoded train and test rows (id, label, features as doubles) and the encoder fitted on the training rows."""

    state: EncoderState
    train: DataFrame
    test: DataFrame


def encode_rows(df: DataFrame, state: EncoderState, keep: tuple[str, ...] = (ID, LABEL)) -> DataFrame:
    rows = engineered(impute(df), state.max_logins, state.max_usage)
    return align(encode(rows, state), state.feature_names, keep)


def model_matrices(df: DataFrame, test_size: float = 0.2, seed: int = 42, check: bool = True) -> Matrices:
    """Stratified split first, encoder from the training rows only, then both sides encoded with it."""
    if check:
        require_valid_values(df)
    parts = stratified_split(df, test_size, seed)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    state = fit_encoder(impute(train))
    return Matrices(state, encode_rows(train, state), encode_rows(test, state))
