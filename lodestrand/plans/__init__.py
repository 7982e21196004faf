"""Registered queries: name, DataFrame plan and, where SQL can say it, the SQL twin."""
