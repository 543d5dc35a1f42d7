"""Batch analytics over tables of timestamped transcripts, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
