"""Spark-first corpus engineering: parse, validate, deduplicate, split, tokenise, pack and audit text corpora."""
