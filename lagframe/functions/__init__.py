"""Column functions: dates, text, flags."""
