"""Readers and writers: event logs, archives, telemetry."""
