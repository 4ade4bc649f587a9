"""Readers for landed files and writers for layers, results and keyed sinks."""
