"""jobtide: job-posting ingest, matching, scoring, search and statistics as Spark plans."""
