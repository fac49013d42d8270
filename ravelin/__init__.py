"""Ravelin: table analytics written as Spark DataFrame functions.

Four kinds of work are covered: panel growth and forecasts, group-fairness
audits, document-corpus state and search, and record reconciliation.
"""
