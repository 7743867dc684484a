"""Out-of-distribution detection over time-stepped recordings, as Spark DataFrames."""
