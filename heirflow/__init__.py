"""Survey-based microsimulation of wealth transfers on Spark DataFrames."""
