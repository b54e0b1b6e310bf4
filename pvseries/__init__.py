"""Hourly solar-power and weather series on Spark DataFrames."""
