"""Whole runs: from a project to its report."""
