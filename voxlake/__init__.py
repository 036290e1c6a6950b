"""Spoken-content analytics on Spark: set-based plans over all episodes at once."""
