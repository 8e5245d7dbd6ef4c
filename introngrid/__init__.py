"""Transcript-isoform and splicing analytics expressed as Spark DataFrame jobs."""
