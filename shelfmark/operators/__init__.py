from . import (  # noqa: F401
    assemble, catalog, clusters, conflicts, enrich, grouping, layout, ledger, neighbours, routing,
    vectors,
)
