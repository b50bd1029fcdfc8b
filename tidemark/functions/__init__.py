"""Column builders: text, numbers, dates, bands and ratios. All are built-in expressions, no UDF."""
