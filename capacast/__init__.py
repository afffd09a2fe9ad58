"""Capacity and revenue analytics as Spark DataFrame jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame building blocks), ``sources`` (reading, writing, schemas), ``plans``
(the domain jobs) and ``streaming`` (the same jobs on Structured Streaming).
"""
