"""Structured Streaming: sales files into a star, events into windows."""
