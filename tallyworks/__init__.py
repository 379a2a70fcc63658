"""Retail order-line analytics as ordinary Spark DataFrame functions."""
