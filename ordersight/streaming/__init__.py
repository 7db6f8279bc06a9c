"""Structured Streaming: source, stateful gap, scoring, sink and live statistics."""
