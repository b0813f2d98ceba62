"""Profiling, rules, drift, forecasts and ranked views over DataFrames."""
