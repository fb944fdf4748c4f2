"""Runnable jobs over the library: `python -m jobs.evaluate_cases` and `python -m jobs.watch_logs`."""
