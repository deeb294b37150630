"""Training-data operators: chat formatting, page text, near duplicates, URL filters, packing,
repeated passages, decontamination, line dedup and language ID.

Nothing outside this package imports it. Operators take and return DataFrames;
:mod:`tandem.llm.queries` applies each to its whole table with production parameters.
"""
