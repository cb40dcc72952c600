"""Operators of the reconciliation library."""
