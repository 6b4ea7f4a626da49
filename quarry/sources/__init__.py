"""Readers and writers: shared tables, generated rows, result CSVs, stat text, sinks."""
