"""Training-data operators: scans, mixing, deduplication, packing, filters, media and archives.

Nothing outside this folder imports it.  Every operator takes a session and DataFrames with
named columns and returns DataFrames; ``queries.py`` binds them to the supplied tables.
"""
