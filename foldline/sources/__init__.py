"""Readers and writers: question-answering JSON lines, append logs, results and reports."""
