"""Runnable jobs over the supplied tables: ``python -m jobs.census`` and ``python -m jobs.lines``."""
