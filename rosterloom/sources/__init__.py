"""Readers of files, pages and catalogs, and the sinks."""
