"""Scans and stores."""
