"""Inputs of the registered queries: event tables and their stand-ins."""
