"""Operators for preparing training text: each module holds one; nothing else in the library imports this folder."""
