"""Security-alert triage analytics as Spark DataFrame transforms."""
