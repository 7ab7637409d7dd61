"""Scans and sinks: product tables, profiles, the store, reports, synthetic data."""
