"""Screening of short texts and evaluation of generated names, on Spark."""
