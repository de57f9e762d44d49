"""DataFrame operators; each takes frames and returns lazy frames."""
