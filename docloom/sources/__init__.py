"""Readers of corpora, page folders and catalogs, and writers of stages, ledgers and sheets."""
