"""Structured Streaming forms of the daily inputs."""
