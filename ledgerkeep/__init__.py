"""Retention analytics for append-only knowledge logs, as functions from DataFrame to DataFrame."""
