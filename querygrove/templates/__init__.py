"""Prompt templates by name, with their slots in braces."""
