"""Operators for preparing training text and the queries over them; nothing else in the library imports this."""
