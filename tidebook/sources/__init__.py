"""Scans of event files and derived event tables."""
