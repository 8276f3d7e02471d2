"""Flow metering, imbalanced-class benchmarking and attack alerting on Spark."""

from netlens.params import FlowParams

__all__ = ["FlowParams"]
