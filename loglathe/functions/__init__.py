"""Scalar pieces: durations, timestamps, patterns, numbers, arithmetic."""
