"""Incremental versions for streams of tracks."""
