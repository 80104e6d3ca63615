"""Customer churn and retention analytics as PySpark DataFrame operators."""
