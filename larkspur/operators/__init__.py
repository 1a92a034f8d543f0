"""What statements do, as DataFrame operations."""
