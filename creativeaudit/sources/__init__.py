"""Readers for media folders, request logs, score caches and reports."""
