"""Training-data operators: licence scans, token files, decontamination, quality,
token counts, URL filters, exact top-k, packing, personal data and Jaccard joins.

Nothing outside this package imports it.  Operators take and return DataFrames;
``queries`` binds them to the tables of a data folder.
"""
