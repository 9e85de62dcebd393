"""Reversible text pseudonymisation and text analytics on Spark."""
