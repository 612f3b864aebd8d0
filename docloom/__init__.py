"""docloom: document intelligence and retrieval as plain DataFrame operators."""
