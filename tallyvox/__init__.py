"""tallyvox: text and opinion analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
