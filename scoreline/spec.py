"""Column roles of a table. Every operator takes its column names from here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    id: str
    target_raw: str
    target: str
    numeric: tuple[str, ...]
    int_binary: tuple[str, ...]
    yes_no: tuple[str, ...]
    categorical: tuple[str, ...]
    lenient: tuple[str, ...] = ()
    """Numeric columns in which anything unreadable means 0.0 instead of an error."""
    segment: str | None = None

    @property
    def binary(self) -> tuple[str, ...]:
        return self.int_binary + self.yes_no

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.binary + self.categorical

    @property
    def raw_columns(self) -> tuple[str, ...]:
        return (self.id, *self.features, self.target_raw)

    @property
    def required_fields(self) -> tuple[str, ...]:
        return (self.id, *self.features)

    def raw_schema(self) -> T.StructType:
        """Landing schema: all strings, typing belongs to cleaning."""
        return T.StructType([T.StructField(c, T.StringType()) for c in self.raw_columns])

    def clean_schema(self) -> T.StructType:
        kinds = (
            [(c, T.DoubleType()) for c in self.numeric]
            + [(c, T.LongType()) for c in self.binary]
            + [(c, T.StringType()) for c in self.categorical]
        )
        fields = [(self.id, T.StringType()), *kinds, (self.target, T.LongType())]
        return T.StructType([T.StructField(n, t) for n, t in fields])


# The columns of the public telco customer table.
TELCO = FeatureSpec(
    id="customerID",
    target_raw="Churn",
    target="churn",
    numeric=("tenure", "MonthlyCharges", "TotalCharges"),
    int_binary=("SeniorCitizen",),
    yes_no=("Partner", "Dependents", "PhoneService", "PaperlessBilling"),
    categorical=(
        "gender",
        "MultipleLines",
        "InternetService",
        "OnlineSecurity",
        "OnlineBackup",
        "DeviceProtection",
        "TechSupport",
        "StreamingTV",
        "StreamingMovies",
        "Contract",
        "PaymentMethod",
    ),
    lenient=("TotalCharges",),
    segment="Contract",
)
