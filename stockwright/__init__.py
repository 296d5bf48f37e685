"""Demand, replenishment, anomaly, causal and synthetic-data analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame (+ parameters) -> DataFrame``.  The driver
only ever holds schemas, a day-axis row, a few hundred quantiles, p x p matrices and small
fitted models; everything whose size grows with the data stays in Spark.
"""
