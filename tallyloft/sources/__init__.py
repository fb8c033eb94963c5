"""Readers and writers: tables, the observation catalogue's views of them, manifests, logs, registries, and page sources."""
