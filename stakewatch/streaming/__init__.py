"""Incremental jobs: new filings, price loads, ranking history, daily activity."""
