"""Reports, thresholds and whole analyses."""
