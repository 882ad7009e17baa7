"""Operators that prepare language-model training data, on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing outside this
subpackage imports it. `queries` registers the contract queries.
"""
