"""What changes files."""
