"""Readers of sample, configuration, result and log files, and of the driver's tables."""
