"""epochal: Spark-first analytics over irregular object-time panels."""

__version__ = "0.1.0"
