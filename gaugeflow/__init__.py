"""Gauge analytics on Spark: cleaning, features, scoring, alerts and documents."""
