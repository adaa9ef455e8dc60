"""Training-data operators for corpora of documents.

Nothing outside this subpackage imports it; ``queries`` holds the entries
that the driver's file adds when the subpackage can be imported.
"""
