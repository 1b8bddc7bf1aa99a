"""gneiss: analytics over catalogue documents, unit tables and passages, written as Spark plans."""
