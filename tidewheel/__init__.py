"""Tidewheel: step-indexed series analytics on Spark."""
