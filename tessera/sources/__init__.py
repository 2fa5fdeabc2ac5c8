"""Readers, writers and path rules.  Paths go through Spark's or Hadoop's file systems, never through open()."""
