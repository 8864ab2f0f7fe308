"""A relational analytics engine on Spark DataFrames."""
