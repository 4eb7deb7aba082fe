"""Importers: source files of a view to rows of the observation families."""
