"""Event-log analytics and one-class alarm triage as Spark DataFrame jobs."""
