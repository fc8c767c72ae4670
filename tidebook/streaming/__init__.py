"""Streaming books."""
