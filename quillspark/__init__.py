"""quillspark: spoken-form text normalization and text-corpus work on Spark DataFrames."""

__version__ = "0.1.0"
