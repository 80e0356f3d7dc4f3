"""Readers: files, endpoints and database dictionaries."""
