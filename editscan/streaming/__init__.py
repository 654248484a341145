"""No operator of this library keeps state between batches of a stream.

All of them are plain DataFrame functions; those without a window or a sort (filters, cut sites,
CIGAR expansion) also take streaming DataFrames as they are.
"""
