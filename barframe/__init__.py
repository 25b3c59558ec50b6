"""Spark DataFrame operators for market research tables.

Every operator is a plain function from DataFrames and parameters to a DataFrame.
"Now" and "today" are always arguments; nothing reads the wall clock.
"""
