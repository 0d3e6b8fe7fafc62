"""Readers, sinks, reports and artifact checks."""
