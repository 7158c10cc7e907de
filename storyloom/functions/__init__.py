"""storyloom.functions."""
