"""Training-data operators: sharding, language, near-duplicates, quality, HTML, WARC, packing, search and BPE."""
