"""gridloom: labelled-grid analytics and corpus operators, expressed as Spark plans."""
