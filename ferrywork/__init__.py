"""Ferrywork: moving, converting and reconciling data on Spark DataFrames."""
