"""Readers and writers: stored tables, recorded host responses, JDBC, source members, call logs."""
