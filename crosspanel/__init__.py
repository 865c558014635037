"""Cross-sectional signal research on plain Spark DataFrames.

A panel is one long DataFrame on a dense grid: a row per date and symbol, columns date, t (0, 1, ... over the calendar), symbol and one
double column per field, null where a value is missing. NaN never enters: readers turn it into null.
"""
