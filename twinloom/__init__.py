"""Temporal property graphs, telemetry, states and events as Spark DataFrames."""
