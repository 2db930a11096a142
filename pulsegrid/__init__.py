"""Sequence-pattern mining over sensor time series, expressed as Spark DataFrame plans."""
