"""Lap, stint and telemetry analytics on Spark DataFrames."""
