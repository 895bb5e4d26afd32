"""Structured Streaming versions."""

from chartloom.streaming.assembly import stream_assemble_blobs
from chartloom.streaming.jobs import (
    read_batches,
    run_flow,
    run_stream,
    run_tagged,
    stream_cohort,
    stream_dedup,
    stream_documents,
    write_cohort_batch,
)

__all__ = [
    "read_batches", "run_flow", "run_stream", "run_tagged", "stream_assemble_blobs", "stream_cohort", "stream_dedup",
    "stream_documents", "write_cohort_batch",
]
