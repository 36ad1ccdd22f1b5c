"""Device-event logs on Spark: ingest, layouts, roll-ups, questions and governed reads."""
