"""Reference-data integration, profiling and name search on Spark DataFrames."""
