"""DataFrame operators: contracts, gates, enrichment, embedding, search, ledger, audit, events."""
