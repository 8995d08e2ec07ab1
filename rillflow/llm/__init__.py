"""Training-data operators: media, deduplication, secrets, quality, WARC fixity,
toxicity, token counts, byte-level BPE and mixing.  Nothing outside this subpackage
imports it."""
