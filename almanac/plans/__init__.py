"""Queries over the driver tables and the SQL that they equal."""
