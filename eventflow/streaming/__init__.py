"""Structured Streaming forms. Stateless operators need none: they take a stream as they are."""
