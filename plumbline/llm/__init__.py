"""Training-data operators: search, mixing, language, dedup, licences, tokens, toxicity.

Nothing outside this subpackage imports it.
"""
