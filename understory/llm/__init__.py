"""Operators of a training-data pipeline: near copies, chats, token files, BPE, PII, search, quality, leaks, URLs, languages."""
