"""cairn: a Spark-first analytics engine for interaction logs, catalogues and text corpora."""

__version__ = "0.1.0"
