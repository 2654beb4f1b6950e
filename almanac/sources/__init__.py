"""Readers of strict text, workbook, XML and table sources."""
