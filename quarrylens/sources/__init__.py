"""Readers of documents, specifications, diagrams, logs and tables."""
