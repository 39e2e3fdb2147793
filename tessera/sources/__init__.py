"""Readers and writers: source files, configuration, the index tables, and staged tables."""
