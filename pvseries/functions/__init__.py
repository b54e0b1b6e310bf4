"""Column expressions: calendar, labels and solar position."""
