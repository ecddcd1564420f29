"""Queries over the derived fixtures, each with its SQL form."""
