"""Trajectory analytics on Spark: see README.md."""
