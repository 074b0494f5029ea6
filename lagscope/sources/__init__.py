"""Readers, sinks, and the input tables that Spark derives from the given ones."""
