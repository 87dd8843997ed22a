"""Readers, payload parsing, source selection and sinks."""
