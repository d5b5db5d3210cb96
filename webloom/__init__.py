"""webloom: web responses to clean, model-ready text, as Spark DataFrame operators."""

__version__ = "0.1.0"
