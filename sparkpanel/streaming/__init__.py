"""Streaming: the reference has no streaming operator; its scheduled drift
report is provided as a Structured Streaming job (``drift_monitor``)."""
