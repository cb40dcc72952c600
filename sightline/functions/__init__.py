"""Functions of the reconciliation library."""
