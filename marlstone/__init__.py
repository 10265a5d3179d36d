"""marlstone: analytics over filings, facts and retrieval corpora as Spark DataFrame transformations."""
