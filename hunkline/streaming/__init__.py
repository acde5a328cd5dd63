"""Structured Streaming: the row-local operators on arriving change-sets (K1)
and content-based suppression of repeated requests (K2)."""
