"""Training-data operators: packing, near-dedup, quality, toxicity, PII, secrets and tokenisation.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` holds the thin registered queries.
"""
