"""Structured Streaming forms of the per-cycle measures and alarms."""
