"""The report tables, grouped by the question they answer."""
