"""Scalar expressions: counter-based random numbers, weight buckets, sample sizes."""
