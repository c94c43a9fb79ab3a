"""Exploratory analytics and anomaly detection as Spark DataFrame operators."""
