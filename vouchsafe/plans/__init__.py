"""Whole plans: the version lifecycle and the registered queries."""
