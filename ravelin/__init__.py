"""ravelin: code-security analytics expressed as Spark DataFrame jobs."""
