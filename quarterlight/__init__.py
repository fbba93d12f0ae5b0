"""Quarter-hour forecasting data engine on Spark DataFrames."""
