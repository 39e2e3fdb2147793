"""Structured Streaming: change events to debounced bursts, and versions that differ from the last one kept."""
