"""Almanac: auditable analytics on daily price, currency and supply-balance histories, on PySpark."""
