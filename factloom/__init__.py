"""factloom: a Spark-native evidence engine.

Facts about a system carry citations, a provenance tier and a validity interval; every operator here is a function from
DataFrames to a DataFrame, so Catalyst sees one declarative plan.
"""
