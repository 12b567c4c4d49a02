"""Registered queries of the matching operators, and the SQL that says the same where SQL can."""
