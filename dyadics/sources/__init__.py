"""Readers and writers of the relations; see readers, text_logs, sinks."""
