"""glossmark: translation evaluation, significance testing and n-best analysis on Spark."""

__version__ = "0.1.0"
