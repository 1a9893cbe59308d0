"""Readers and writers of readings, records and contracts."""
