"""Structured Streaming counterparts of batch operators."""
