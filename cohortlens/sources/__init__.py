"""Readers, writers and the study's table schemas."""
