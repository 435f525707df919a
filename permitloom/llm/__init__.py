"""Training-data operators: ten independent operators over document-like tables.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` applies them to the driver's tables.
"""
