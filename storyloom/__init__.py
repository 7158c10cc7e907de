"""storyloom: content-intelligence operators as PySpark DataFrame jobs."""
