"""Readers of text inputs and configuration, writers of results."""
