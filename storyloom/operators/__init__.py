"""storyloom.operators."""
