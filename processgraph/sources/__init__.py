"""Readers and writers: tables, logs, JSON, note text, triples."""
