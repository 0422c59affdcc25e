"""Declared schemas, readers, sinks and the views over the star-schema tables."""
