"""Part of plexmatch."""
