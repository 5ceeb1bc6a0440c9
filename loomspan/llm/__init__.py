"""Operators of a training-data pipeline: packing, de-duplication, search,
classification, tokenisation, language identification and archive conversion.

Nothing outside this subpackage imports it.
"""
