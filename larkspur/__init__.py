"""Analytics over agent loadouts, session traces and text corpora, expressed as Spark plans."""
