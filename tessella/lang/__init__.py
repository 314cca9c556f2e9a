"""The query language: tokens, statements, parser."""
