"""duelframe: a PySpark engine for pairwise-preference data and the features around it."""

__version__ = "0.1.0"
