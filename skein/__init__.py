"""skein: conversational-corpus curation and evaluation as Spark plans."""
