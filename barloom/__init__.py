"""Price-bar features, labels and signals on Spark DataFrames."""
