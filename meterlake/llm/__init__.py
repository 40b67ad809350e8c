"""Training-data operators: fingerprints, packing, PII, licences, token files, BPE, chat, language, media, near-duplicates."""
