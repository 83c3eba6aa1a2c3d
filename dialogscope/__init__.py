"""Conversation-evaluation analytics expressed as Spark DataFrame jobs."""
