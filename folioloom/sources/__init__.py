"""Corpus sources: tables and file trees."""

from folioloom.sources.files import list_files, read_contents, read_lines, read_tree
from folioloom.sources.tables import corpus_from_table

__all__ = ["corpus_from_table", "list_files", "read_contents", "read_lines", "read_tree"]
