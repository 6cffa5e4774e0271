"""Repository-intelligence engine on Spark DataFrames."""
