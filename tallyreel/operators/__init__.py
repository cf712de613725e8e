"""Building blocks: grouping helpers, totals, engagement, ranking, upserts, audits."""
