"""Structured Streaming: the collector and the keyed sampler."""
