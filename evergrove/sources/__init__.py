"""Readers and writers: XML, report extraction, JSON, CSV, TOML, files."""
