"""Structured Streaming twins of the telemetry and ledger operators."""
