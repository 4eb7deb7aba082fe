"""Structured Streaming: property monitors over endless traces, latest observations, findings by time."""
