"""Importing this package registers every query."""

from . import decisions, expressions, flows, processing, prompts, quality, reviews, routing, scoring, topics  # noqa: F401
