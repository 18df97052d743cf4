"""Operators on data frames: index construction, retrieval, ranking, graphs and relations."""
