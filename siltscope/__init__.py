"""siltscope: source-code corpus and scan-history analytics on Spark DataFrames."""

from siltscope.session import get_spark

__all__ = ["get_spark"]
