"""Readers and writers of the text formats: indexes, frequencies, dictionaries, logs, annotated texts."""
