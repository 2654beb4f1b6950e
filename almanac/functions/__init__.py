"""Scalar and column functions shared by operators."""
