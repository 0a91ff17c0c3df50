"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can."""
