"""Readers and writers: tables, raw files, state and model settings."""
