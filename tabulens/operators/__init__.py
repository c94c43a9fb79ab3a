"""Profiling, cleaning, statistics, time-series and chart-number operators."""
