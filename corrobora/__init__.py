"""Provenance analytics on PySpark DataFrames.

Tables of tiered sources, documents, evidence claims and the links between them
go in; evidence class, signal strength, gates, admissions, audits and readiness
come out.  Every public function takes DataFrames (or Columns) and returns a
DataFrame (or Column); nothing keeps session state.
"""
