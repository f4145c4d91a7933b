"""Readers and writers for captures, corpora, predictions and fitted recipes."""
