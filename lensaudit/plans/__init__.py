"""Whole audits: stages composed of operators, and the command line."""
