"""Offline recommender evaluation on Spark: ratings in, tidy metric tables out."""

__version__ = "0.1.0"
