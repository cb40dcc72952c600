"""Plans of the reconciliation library."""
