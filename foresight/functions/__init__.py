"""Column expressions: dates, flags, labels and display formats."""
