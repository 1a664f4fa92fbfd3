"""callscope: PySpark jobs that turn agent tool-call logs into an enriched
``tool_calls`` table and answer operational questions over it."""
