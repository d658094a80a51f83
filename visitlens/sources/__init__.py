"""Readers, sinks, JSON payloads and SQL registration."""
