"""Column functions and fixed tables of the trace format."""
