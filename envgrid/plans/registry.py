"""All driver queries with their SQL oracles, by name."""

from __future__ import annotations

from envgrid.plans import climate, evaluation, fields, formats, learning, pipelines, streams, verification

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (verification, fields, climate, pipelines, formats, streams, learning, evaluation):
    QUERIES |= _m.reg.queries
    ORACLES |= _m.reg.oracles
