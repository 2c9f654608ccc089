"""logpipe: a Spark-native log pipeline (parse, filter, transform, fan out)."""

__version__ = "0.1.0"
