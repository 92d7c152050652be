"""chronoplane: causal, point-in-time time-series analytics as PySpark plans."""
