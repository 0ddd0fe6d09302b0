"""A document-overlap analytics engine on Spark."""
