"""Outputs: JSON, HTML and SARIF reports, envelopes, summaries."""
