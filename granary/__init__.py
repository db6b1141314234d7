"""granary: retrieval analytics over document corpora, on Spark."""

__version__ = "0.1.0"
