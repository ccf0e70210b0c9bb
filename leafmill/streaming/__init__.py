"""Streams of job heartbeats."""
