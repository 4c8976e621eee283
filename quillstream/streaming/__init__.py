"""Structured Streaming versions of the stateful operators; on the same input they give what the batch ones give."""
