"""Operators for preparing training text: filters, dedup, language, toxicity, tokens, mixing.

Nothing outside this folder imports it.
"""
