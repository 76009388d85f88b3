"""Reading and writing tables and geographic feature files."""
from areastats.sources.features import FEATURE_SCHEMA, explode_features, read_features  # noqa: F401
from areastats.sources.tables import discard, materialise, read_table, scratch_path, write_table  # noqa: F401
