"""Counts that follow alignment files as they arrive."""
