"""Operators: interval join, bucketed scans, parameter tables, top-k, diff."""
