"""DataFrame -> DataFrame operators (ingest, match, replies, merge, vocab, display)."""
