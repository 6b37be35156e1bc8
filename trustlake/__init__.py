"""Document-trust analytics on Spark: signals, classification, scan history and review findings."""
