"""Relational operators of the checks, and the rules made of them."""
