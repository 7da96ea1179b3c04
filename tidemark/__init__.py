"""Leak-safe analytics over timestamped, keyed, text-bearing tables, on Spark."""
