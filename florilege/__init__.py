"""florilege: document analytics and text retrieval on Spark DataFrames."""
