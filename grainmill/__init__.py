"""Grainmill: a PySpark-native engine for semi-structured record analytics.

Everything is a plain function from DataFrames to DataFrames.  Operators declare logical
plans with built-in expressions; Python appears only where no expression exists, and
then in Arrow batches.
"""
