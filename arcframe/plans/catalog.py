"""Registered queries of the core library and the SQL they are compared with."""

from __future__ import annotations

from arcframe.plans import archive, files, ranges, relational, savers, scalar

QUERIES: dict = {**scalar.QUERIES, **relational.QUERIES, **archive.QUERIES, **files.QUERIES, **ranges.QUERIES, **savers.QUERIES}
ORACLES: dict = {**scalar.ORACLES, **relational.ORACLES, **archive.ORACLES, **files.ORACLES, **ranges.ORACLES, **savers.ORACLES}
