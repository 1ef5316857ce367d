"""Operators for preparing training corpora; nothing else in tidemark imports this package."""
