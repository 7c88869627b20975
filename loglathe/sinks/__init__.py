"""Results as text and files."""
