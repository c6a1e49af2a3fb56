"""Content-addressed version history as DataFrames: set-oriented operators for PySpark."""
