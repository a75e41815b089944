"""Readers of snapshots, listings, logs and files, and writers of results."""
