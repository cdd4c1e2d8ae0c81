"""Readers, writers and table layouts."""
