"""Readers, type inference, sampling, schema tables and the run history."""
