"""The row-wise operators on unbounded input."""

from folioloom.streaming.clean import clean_stream, start_batch_documents, start_clean_table

__all__ = ["clean_stream", "start_batch_documents", "start_clean_table"]
