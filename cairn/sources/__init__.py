"""Point sets and logs: readers and writers."""
