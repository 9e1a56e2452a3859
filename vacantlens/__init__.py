"""Posting-requirements analytics as Spark DataFrame operators.

``functions``  column rules (Column -> Column)
``sources``    declared schemas, readers, page field extraction, sinks
``operators``  table-level operators (DataFrame -> DataFrame)
``streaming``  continuous ingest
``plans``      the operators bound to concrete tables, one plan per query
"""
