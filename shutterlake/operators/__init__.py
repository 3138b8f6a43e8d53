"""Operators on catalog tables: filters, facets, ranking, entities, time, mutations."""
