"""Sinks: a nested payload (JSON), text reports and a Markdown digest."""
