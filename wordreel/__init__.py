"""Spoken-word analytics on Spark: word tables in, cut lists, captions and timelines out."""

__version__ = "0.1.0"
