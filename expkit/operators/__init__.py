"""Operators: builders (B), exposure (X), metrics (M), statistics (H), scorecard (R), reconciliation (V)."""
