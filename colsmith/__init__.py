"""Tabular preparation and feature analytics on Spark DataFrames.

Every learned step is a *fit* that returns a small JSON-serialisable state and an
*apply* that is a plain ``DataFrame -> DataFrame`` function.
"""
__version__ = "0.1.0"
