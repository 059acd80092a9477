"""Operators for preparing text corpora: decontamination, language, quality,
secrets, sharding, line rules, byte-pair codes, licenses and duplicates."""
