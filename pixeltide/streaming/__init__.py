"""Streaming forms of the sampling, rate and tracking operators: watermarks, windows and keyed state."""
