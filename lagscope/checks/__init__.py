"""Independent SQL for the registered queries, and the comparison that uses it."""
