"""Relational and dataflow operators over document records."""
