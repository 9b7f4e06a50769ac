"""Reports over the prepared facts, profiling and data quality."""
