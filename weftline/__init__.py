"""weftline: curation and analytics of conversational training data on PySpark."""
