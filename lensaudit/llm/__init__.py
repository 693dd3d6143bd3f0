"""Operators for large text corpora: mixing, scoring, de-duplication, encoding and classification.

Every operator keeps its rows distributed; what reaches the driver is bounded by a documented parameter
or has one row for each source, language or class. Nothing outside this subpackage imports it.
"""
