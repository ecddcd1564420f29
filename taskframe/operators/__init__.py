"""Relational operators on task graphs, run logs and metric streams."""
