"""Readers and sinks: binary traces, snapshot points, property exports."""
