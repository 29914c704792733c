"""Officer-purchase analytics as Spark jobs: filings and prices in, signals, rankings and page rows out."""
