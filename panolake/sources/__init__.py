"""Readers and writers of annotation documents, and configuration."""
