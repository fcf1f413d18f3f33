"""Readers: FASTA records, alignment hits and id lists."""
