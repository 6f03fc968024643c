"""Where messages come from and go to: topics, files, timers, reference data."""
