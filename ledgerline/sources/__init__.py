"""Readers of partitioned raw records, CSV and XML, and writers that keep what was written."""
