"""Readers and writers: records, archives, the hot and cold tables, metric samples."""
