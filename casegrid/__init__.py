"""Casegrid: case-document ingest, retrieval and chronology on Spark DataFrames."""
