"""Column functions and the time-splitting window helpers."""
