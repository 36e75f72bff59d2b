"""Readers, payload decoders, writers and the demo inputs."""
