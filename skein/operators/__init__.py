"""Operators over message logs, state, tool gates, human decisions, chunks and tables."""
