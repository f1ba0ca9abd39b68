"""Sources: the logical input tables (``SourceCatalog``) and their bindings."""

from trialspark.sources.catalog import SourceCatalog, normalise  # noqa: F401
from trialspark.sources.fixtures import fixture_catalog  # noqa: F401
from trialspark.sources.readers import parquet_catalog, store_bucketed, table_catalog  # noqa: F401
