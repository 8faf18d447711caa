"""Structured Streaming: audits of landing pages, and their changes."""
