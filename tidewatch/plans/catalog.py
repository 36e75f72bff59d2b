"""All registered queries."""

from tidewatch.plans import catalog_panel, catalog_eval, catalog_ledger, catalog_models, catalog_risk  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES, oracles  # noqa: F401
