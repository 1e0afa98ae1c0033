"""Relational operators: those that Spark has, as queries, and those it lacks, as functions."""
