"""Feature engineering stages for MLlib, built from the column roles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.spec import FeatureSpec

FEATURES = "features"


def stages(spec: FeatureSpec) -> list:
    """Index, one-hot, standardise the numeric block only, assemble. The id never enters.

    All categorical columns go through one indexer, which counts them in a single pass. Values
    unseen in training get a slot of their own instead of failing.
    """
    index = [f"{c}_idx" for c in spec.categorical]
    hot = [f"{c}_hot" for c in spec.categorical]
    out = []
    if spec.categorical:
        out += [
            StringIndexer(inputCols=list(spec.categorical), outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"),
        ]
    return out + [
        VectorAssembler(inputCols=list(spec.numeric), outputCol="numeric_vec", handleInvalid="keep"),
        StandardScaler(inputCol="numeric_vec", outputCol="numeric_scaled", withMean=True, withStd=True),
        VectorAssembler(
            inputCols=["numeric_scaled", *spec.binary, *hot], outputCol=FEATURES, handleInvalid="keep"
        ),
    ]


def feature_pipeline(spec: FeatureSpec) -> Pipeline:
    return Pipeline(stages=stages(spec))


def standardize(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Numeric columns as z-scores (sample deviation) beside the id."""
    assembler, scaler = [s for s in stages(spec) if isinstance(s, (VectorAssembler, StandardScaler))][:2]
    model = Pipeline(stages=[assembler, scaler]).fit(df)
    z = vector_to_array("numeric_scaled")
    scaled = model.transform(df).select(spec.id, z.alias("z"))
    return scaled.select(
        spec.id, *[F.round(F.col("z")[i], 6).alias(c) for i, c in enumerate(spec.numeric)]
    )


def explode_vector(df: DataFrame, key: str, column: str = FEATURES) -> DataFrame:
    return df.select(key, vector_to_array(column).alias(column))


def feature_names(df: DataFrame, column: str = FEATURES) -> list[str]:
    """Names of the vector's slots from the column metadata; no job runs."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for attrs in groups.values() for a in attrs)
    return [name for _, name in slots]
