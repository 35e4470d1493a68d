"""Parameter tables and projects from files, text and code."""
