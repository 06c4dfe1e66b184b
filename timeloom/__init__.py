"""Spark jobs for stage-aware retrieval and conversation memory."""
