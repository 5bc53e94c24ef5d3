"""Relational operators over spans, hits, placeholders and the audit log."""
