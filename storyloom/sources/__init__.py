"""storyloom.sources."""
