"""Workflow analytics on Spark: task graphs, run logs and metric streams as DataFrames."""
