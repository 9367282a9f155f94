"""Scans, typed schemas, bindings to the supplied tables, sinks."""
