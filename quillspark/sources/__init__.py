"""Readers and writers: tables, page files, timing logs, index artefacts."""
