"""Curation, profiling, labelling and scoring of text-to-SQL corpora on Spark.

Every operator takes and returns DataFrames; every scalar function takes and
returns Columns.  Nothing here runs a Spark job unless its docstring says so.
"""

__version__ = "0.1.0"
