"""ledgerline: record auditing, reconciliation and measurement on PySpark DataFrames."""
