"""Readers: vendor logs, git history and lake files to the two tables.

Vendor parsers take a DataFrame of raw lines:

    session_key   which session the line belongs to
    developer, machine, project
    chunk, seq    where the line stands: byte block of its file, order inside it
    line          the text
"""
