"""Operators over labelled datasets: each takes and returns DataFrames."""
