"""Consumption-adjusted revenue analytics as Spark DataFrame plans."""
