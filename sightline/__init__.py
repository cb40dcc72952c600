"""Observed-versus-declared reconciliation as Spark DataFrame operators."""
