"""lumenloom: evaluation analytics and training-data operators on Spark DataFrames."""
