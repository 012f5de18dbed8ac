"""Evidence-grade studies on time series, as Spark DataFrame operators."""

__version__ = "0.1.0"
