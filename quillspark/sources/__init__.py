"""Readers: files and markup to rows."""
