"""Readers and writers of tracks, networks, sequences and distance indexes."""
