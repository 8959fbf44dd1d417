"""Table preparation, profiling, charts and modelling on Spark DataFrames."""
