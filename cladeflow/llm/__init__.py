"""Operators for preparing training text at corpus scale.

Nothing outside this folder imports it, so the rest of the package works
without it.
"""
