"""Operators of the workload engine."""
