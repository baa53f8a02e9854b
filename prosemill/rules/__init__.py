"""Rules and thresholds as data."""
