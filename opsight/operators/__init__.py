"""Operators over load-framework metadata, one module per SURVEY section."""
