"""Reading and writing tables, files and messages."""
