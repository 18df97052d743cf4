"""A search and analytics engine for document collections and link graphs, on Spark data frames."""
