"""polarmesh: polar-ocean and sea-ice mesh analytics on Spark DataFrames.

Subpackages are imported on demand; importing this package loads nothing else.
"""
