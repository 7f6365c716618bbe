"""rollbook: subscription, fleet-usage and churn analytics as PySpark DataFrame functions."""
