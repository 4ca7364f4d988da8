"""Poverty measurement and transfer targeting on household surveys, on Spark.

Every operator takes and returns Spark DataFrames; role columns (outcome,
weight, id, group) are arguments. See README.md for the layout.
"""
