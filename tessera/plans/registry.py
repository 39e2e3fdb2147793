"""All registered queries of the core operators and their SQL."""

from __future__ import annotations

from tessera.plans import code, history, text, workspace

QUERIES = {**text.QUERIES, **code.QUERIES, **history.QUERIES, **workspace.QUERIES}
ORACLES = {**text.ORACLES, **code.ORACLES, **history.ORACLES, **workspace.ORACLES}
