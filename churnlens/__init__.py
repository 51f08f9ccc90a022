"""churnlens: customer-churn analytics as Spark DataFrame operators and MLlib pipelines."""

__version__ = "0.1.0"
