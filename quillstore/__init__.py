"""quillstore: typed key/value snapshots and bulk lookups as Spark DataFrames."""

__version__ = "0.1.0"
