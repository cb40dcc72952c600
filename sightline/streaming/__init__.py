"""Streaming of the reconciliation library."""
