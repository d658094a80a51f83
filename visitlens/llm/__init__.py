"""Training-data operators: quality scoring, de-duplication, packing, sharding,
mixing, licence scans, exact search and page extraction.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`visitlens.llm.queries` derives the
registered ``opN_<name>`` results from them.
"""
