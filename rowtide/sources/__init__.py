"""Readers and writers: sparse CSV and binary recordings."""
