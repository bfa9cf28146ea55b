"""Column functions: parsing, dates, rounding, bands, text, statistics, finance."""
