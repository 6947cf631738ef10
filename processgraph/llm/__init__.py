"""Operators for preparing training text: every one covers whole tables and whole texts."""
