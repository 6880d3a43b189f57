"""Readers and writers for run metrics, summaries, event logs, tuning sheets and evidence."""
