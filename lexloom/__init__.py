"""Corpus preparation for language-model training, written as Spark DataFrame operations."""
