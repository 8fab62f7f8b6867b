"""riskspark — account-risk analytics as Spark DataFrame operators."""

from riskspark.config import DEFAULT_CONFIG, RiskConfig

__all__ = ["DEFAULT_CONFIG", "RiskConfig"]
__version__ = "0.1.0"
