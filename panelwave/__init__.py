"""Panel building and staggered difference-in-differences on Spark DataFrames."""

from panelwave.plans.design import ModelSpec

__all__ = ["ModelSpec"]
