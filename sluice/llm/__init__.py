"""Training-data operators: filters, dedup, joins, classifiers, tokenizers, mixing and sharding.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and the names of its id and text columns and returns a new DataFrame; columns
it does not know are ignored, so extra columns of any name are harmless.
"""
