"""ranksmith: hybrid retrieval, rank fusion and ranking-oriented data processing on PySpark DataFrames."""

__version__ = "0.1.0"
