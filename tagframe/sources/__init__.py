"""Readers and writers: driver tables, delimited files, literal parsing, logs."""
