"""Data-quality rule analytics on Spark."""
