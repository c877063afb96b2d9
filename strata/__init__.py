"""strata: code search, history analytics and corpus processing as Spark plans."""

__version__ = "0.1.0"
