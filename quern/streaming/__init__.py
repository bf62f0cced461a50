"""Structured Streaming over telemetry: the same expressions as in batch, with state and sinks."""
