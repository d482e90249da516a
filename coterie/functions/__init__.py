"""Coterie subpackage."""
