"""Batch operators over logs and metric samples."""
