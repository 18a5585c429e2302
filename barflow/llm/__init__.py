"""Operators for preparing training text at scale; nothing else in barflow imports this."""
