"""Operators put together into jobs."""
