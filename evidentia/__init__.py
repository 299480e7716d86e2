"""evidentia: a Spark-first engine for evidence-centred text analytics."""

__version__ = "0.1.0"
