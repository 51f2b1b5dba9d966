"""Column functions: text, dates, numbers and nested values."""
