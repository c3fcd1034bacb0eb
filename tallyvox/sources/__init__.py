"""Readers and writers: landed JSON, post tables, lookup files."""
