"""Loomledger: crawl-ledger, page-corpus and document-ledger analytics as Spark jobs."""
