"""Structured Streaming: standing search, folds of event logs, throttles."""
