"""Event-burst analytics on Spark: detection, scoring, ranking and evaluation of rallies in event tables."""
