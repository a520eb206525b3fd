"""quillmere: a Spark-first analytics engine for benchmarking time-series methods."""

__version__ = "0.1.0"
