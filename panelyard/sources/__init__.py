"""Scans and sinks: panels, predictions, flags, masks, metrics."""
