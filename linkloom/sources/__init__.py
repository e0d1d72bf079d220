"""Readers and writers of the text formats, and table round trips."""
