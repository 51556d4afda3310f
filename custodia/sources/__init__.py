"""Table sources: the catalog and the fixture tables derived from the
driver's test data."""

from custodia.sources.catalog import Catalog
from custodia.sources.fixtures import fixture_catalog

__all__ = ["Catalog", "fixture_catalog"]
