"""Readers and writers: document shards, landed web payloads, logs, vocabularies, file manifests."""
