"""scoreline: prepare, score and monitor tabular classification data with PySpark."""

from scoreline.spec import TELCO, FeatureSpec

__all__ = ["FeatureSpec", "TELCO"]
