"""The batch flow over a stream of files."""
