"""Point-in-time panel analytics as plain DataFrame-to-DataFrame transforms on PySpark."""
