"""Readers and writers of wordlist formats."""
