"""Feature vectors: fitted once on the training rows, then plain ML stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.columns import (
    boolean_columns,
    categorical_columns,
    numeric_columns,
    temporal_columns,
)
from gridlens.operators.profile import value_counts
from gridlens.operators.ranking import quantiles

FEATURES = "features"
MAX_CATEGORIES = 500_000


@dataclass
class FeatureModel:
    """Stages from raw columns to one vector, and the name of each position; the first `numeric` are no 0/1 columns."""

    stages: PipelineModel
    names: list[str]
    scratch: list[str]
    numeric: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(df).drop(*self.scratch)

    def numbers(self, df: DataFrame) -> DataFrame:
        """Appends the first `numeric` positions, a column each."""
        return self.stages.stages[0].transform(df) if self.numeric else df


def _as_number(df: DataFrame, name: str) -> str:
    """SQL text for a column as a double; dates become seconds, NaN and infinite
    values are missing."""
    c = "`" + name.replace("`", "``") + "`"
    if name in temporal_columns(df):
        return f"cast(unix_micros(cast({c} as timestamp)) / 1e6 as double)"
    return f"if(abs(cast({c} as double)) < double('inf'), cast({c} as double), null)"


def feature_columns(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Those that become numbers, and those that become 0/1 columns."""
    plain = [*numeric_columns(df), *boolean_columns(df), *temporal_columns(df)]
    numbers = [c for c in columns if c in plain]
    text = [c for c in columns if c in categorical_columns(df)]
    unsupported = [c for c in columns if c not in numbers and c not in text]
    if unsupported:
        raise ValueError(f"columns of unsupported type: {unsupported}")
    return numbers, text


def _means_and_deviations(df: DataFrame, columns: Sequence[str], n: Column) -> list[tuple[float, float]]:
    """Per column without gaps, where a row counts n times; exactly 0 is the deviation of equal values."""
    first = df.agg(
        F.sum(n).alias("n"), *[F.struct(F.sum(F.col(c) * n).alias("s"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns]
    ).first()
    means = [first[c]["low"] if first[c]["low"] == first[c]["high"] else first[c]["s"] / first["n"] for c in columns]
    squares = df.agg(*[F.sum((F.col(c) - F.lit(m)) ** 2 * n).alias(c) for c, m in zip(columns, means)]).first()
    return [(m, (squares[c] / first["n"]) ** 0.5) for c, m in zip(columns, means)]


def fit_features(df: DataFrame, columns: Sequence[str] | None = None, counted: str | None = None) -> FeatureModel:
    """Median-impute and scale numbers, one-hot encode text without its first value.

    The column `counted` may say how many rows each stands for.

    Numbers come as (x - mean) / population deviation.  The 0/1 columns are
    divided by theirs and not centred, which only moves the intercept and
    keeps the vectors sparse.  Columns without any value are left out.
    """
    numbers, text = feature_columns(df, df.columns if columns is None else columns)
    n = F.col(counted) if counted else F.lit(1)
    stages, inputs, names, scratch = [], [], [], []
    if numbers:
        raw = df.select(*[F.expr(_as_number(df, c)).alias(f"c{i}") for i, c in enumerate(numbers)], n.alias("n"))
        medians = {r["column"]: r["q0"] for r in quantiles(raw, raw.columns[:-1], [0.5], rows="n" if counted else None).collect()}
        used = [i for i in range(len(numbers)) if f"c{i}" in medians]
        found = _means_and_deviations(raw.fillna(medians), [f"c{i}" for i in used], F.col("n")) if used else []
        cells = [
            f"(coalesce({_as_number(df, numbers[i])}, {medians[f'c{i}']!r}D) - {m!r}D) / {(s or 1.0)!r}D as _num{i}"
            for i, (m, s) in zip(used, found)
        ]
        if cells:
            stages.append(SQLTransformer(statement=f"select *, {', '.join(cells)} from __THIS__"))
        inputs += [f"_num{i}" for i in used]
        names += [numbers[i] for i in used]
        scratch += [f"_num{i}" for i in used]
    if text:
        counts: dict[str, dict[str, int]] = {c: {} for c in text}
        found = value_counts(df, text, counted).limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"text columns {text} have over {MAX_CATEGORIES} values; a model holds "
                             "one weight for each: drop or group them first")
        for r in found:
            counts[r["column"]][r["value"]] = r["n"]
        rows = df.agg(F.sum(n)).first()[0] or 0
        for k, c in enumerate(text):
            # descending, so that the value to leave out comes last
            labels = sorted(counts[c], reverse=True)
            if len(labels) < 2:
                continue
            shares = [counts[c][v] / rows for v in labels[:-1]]
            stages += [
                StringIndexerModel.from_labels(
                    labels, inputCol=c, outputCol=f"_idx{k}", handleInvalid="keep"
                ),
                OneHotEncoder(inputCol=f"_idx{k}", outputCol=f"_hot{k}", dropLast=True),
                VectorSlicer(inputCol=f"_hot{k}", outputCol=f"_cut{k}",
                             indices=list(range(len(labels) - 1))),
                ElementwiseProduct(
                    inputCol=f"_cut{k}", outputCol=f"_cat{k}",
                    scalingVec=Vectors.dense([1.0 / ((p * (1 - p)) ** 0.5 or 1.0) for p in shares]),
                ),
            ]
            inputs.append(f"_cat{k}")
            names += [f"{c}_{v}" for v in labels[:-1]]
            scratch += [f"_idx{k}", f"_hot{k}", f"_cut{k}", f"_cat{k}"]
    if not inputs:
        raise ValueError("no usable feature columns")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    fitted = []
    shape = df.limit(0)
    for stage in stages:
        # the encoder reads its width from the indexer's metadata, not from rows
        model = stage.fit(shape) if hasattr(stage, "fit") else stage
        shape = model.transform(shape)
        fitted.append(model)
    return FeatureModel(PipelineModel(fitted), names, scratch, sum(n.startswith("_num") for n in inputs))



def column_list(df: DataFrame, target: str, leave_out: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != target and c not in leave_out]
