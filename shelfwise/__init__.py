"""Turns collections of short text records into named, reviewable categories on Spark."""
