"""Structured Streaming jobs: catalogue changes, object events and their delivery."""
