"""Airline network analytics as plain PySpark DataFrame functions."""
