"""Sinks: ordered documents and tables."""

from folioloom.sinks.documents import (NoFilesError, document_files, iterate_document, write_document, write_formatted,
                                       write_group_documents)

__all__ = ["NoFilesError", "document_files", "iterate_document", "write_document", "write_formatted",
           "write_group_documents"]
