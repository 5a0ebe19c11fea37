"""Document-table geometry and training-data operators on Spark DataFrames."""
