"""Audits that follow a folder as images arrive."""
