"""Training-data operators: packing, deduplication, mixing, search, archives, language and licence scans."""
