"""Sources: raw files with fixed schemas, or the mapping from the driver's test tables."""

from ledgerline.sources.files import Sources, read_csv_sources, read_parquet_sources
from ledgerline.sources.testdata import testdata_sources

__all__ = ["Sources", "read_csv_sources", "read_parquet_sources", "testdata_sources"]
