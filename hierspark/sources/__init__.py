"""Readers of the text formats and folder layouts; every reader returns a canonical table."""
