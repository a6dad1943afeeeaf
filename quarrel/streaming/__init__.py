"""No streaming operators: collections are bounded, and every query over them is a batch query."""
