"""Sources of the reconciliation library."""
