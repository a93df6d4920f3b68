"""Operators for large-scale training-data pipelines, built on Spark DataFrames.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries only
where it is installed.
"""
