"""Training-data operators: language-model scoring, token counts, WARC, decontamination, BPE, PII, near-dedup, quality, secrets, mixing, ranked search, clustering."""
