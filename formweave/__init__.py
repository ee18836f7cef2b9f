"""formweave: documents, extracted fields, business rules and their evaluation as Spark plans."""
