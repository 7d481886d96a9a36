"""Readers, decoders and table writers."""
