"""Streams: extras for event tables, beyond what a batch rebuild needs."""
