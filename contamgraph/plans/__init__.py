"""Plan helpers: lineage cuts in shared storage and driver-side sizing."""
from contamgraph.plans.lineage import cut, ensure_checkpoint_dir, read_table  # noqa: F401
