"""Typed property graphs on PySpark: sources, upsert, metrics, queries and sinks as DataFrames."""
