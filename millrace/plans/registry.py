"""All registered queries of the core and their SQL."""

from __future__ import annotations

from millrace.plans import advanced, core, evaluation, more

assert advanced and evaluation and more  # its queries register themselves on import

QUERIES = {**core.QUERIES}
ORACLES = {**core.ORACLES}
