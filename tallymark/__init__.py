"""Deterministic, evidence-bound analytics over append-only observation logs, on Spark."""
