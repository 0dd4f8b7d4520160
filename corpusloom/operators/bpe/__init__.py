"""Two-stage subword vocabularies: learning, artifacts, encoding and decoding."""
