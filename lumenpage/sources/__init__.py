from lumenpage.sources.shipping import ship_package
from lumenpage.sources.tables import read_table, release, shared_dir, stage, trim_native

__all__ = ["read_table", "release", "shared_dir", "ship_package", "stage", "trim_native"]
