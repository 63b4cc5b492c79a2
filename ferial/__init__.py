"""ferial: calendar-driven document assembly and data-quality auditing on PySpark."""
