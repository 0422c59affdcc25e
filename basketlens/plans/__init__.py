"""Whole studies: chains of jobs that end in named result tables."""
