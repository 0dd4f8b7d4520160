"""Corpus analytics and subword-tokenizer engine on Spark."""
