"""Operators that prepare text for language models: one module per operator, their queries in ``queries``."""
