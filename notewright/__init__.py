"""Turns collections of free-text clinical notes into structured equipment orders on Spark.

Everything here is a function over Columns or DataFrames: a note is a row, an order is
ten columns, and a job is a chain of projections with a join only where two tables meet.
"""

__version__ = "0.1.0"
