"""storyloom.plans."""
