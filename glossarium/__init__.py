"""Comparative wordlist analytics on Spark."""
