"""tallyproof: checked, source-linked evidence from periodic metrics, on Spark."""
