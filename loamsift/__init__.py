"""Issue-text curation and scoring as Spark plans."""
