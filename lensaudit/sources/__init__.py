"""Readers of image folders, CSV manifests and annotation lists."""
