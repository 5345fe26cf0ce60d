"""Writing-style and authorship analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
