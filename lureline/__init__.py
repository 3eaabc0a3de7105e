"""Phishing analytics as Spark DataFrame operators."""
