"""Fixed values the operators need."""
