"""Prepared facts, the test views and the query catalogue."""
