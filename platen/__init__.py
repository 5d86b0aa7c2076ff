"""platen: document-layout analytics as PySpark DataFrame plans."""
