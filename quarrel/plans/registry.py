"""All queries over the reference operators, by name, with the SQL that checks them."""

from __future__ import annotations

from quarrel.plans import collections, relational, rules

FLAGSHIP = "j1_inner_join"
QUERIES = relational.QUERIES | collections.QUERIES | rules.QUERIES
ORACLES = relational.ORACLES | collections.ORACLES | rules.ORACLES
