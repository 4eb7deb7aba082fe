"""Whole plans: the check of a project, reviews of reports and contracts, and the registered queries."""
