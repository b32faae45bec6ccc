"""Readers and writers for layers, tables and models."""
