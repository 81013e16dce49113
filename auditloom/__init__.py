"""auditloom: dataset auditing and prediction evaluation on PySpark DataFrames."""
