"""Runnable jobs: each has a command line, a config file beside it, and one function that takes a session."""
