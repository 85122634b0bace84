"""Readers and writers: FASTA text and filter files."""
