"""All queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from boxwise.plans import matchups, models, profiles, relations, samples

PLANS = profiles.PLANS | relations.PLANS | models.PLANS | matchups.PLANS | samples.PLANS
QUERIES = {name: query for name, (query, _) in PLANS.items()}
ORACLES = {name: sql for name, (_, sql) in PLANS.items() if sql}
