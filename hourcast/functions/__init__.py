"""Column expressions: calendar, holidays, null handling, losses."""
