"""Review analytics over documents, findings, graphs and events, declared as Spark plans."""
