"""Readers and writers for raw tables, nested JSON and run artifacts."""
