"""ledgerloom: document-table analytics expressed as Spark DataFrame plans."""
