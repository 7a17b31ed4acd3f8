"""callframe: preparation, auditing and evaluation of tool-calling data on Spark."""

__version__ = "0.1.0"
