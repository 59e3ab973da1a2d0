"""Readers, stored tables, the file ledger and result export."""
