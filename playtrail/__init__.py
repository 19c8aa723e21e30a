"""Viewing-history analytics and recommendation as Spark DataFrame operators."""
