"""Coterie: a Spark-native engine for finding, pricing and explaining groups of linked payment activity."""
