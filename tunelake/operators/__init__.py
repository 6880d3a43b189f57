"""Table-to-table operators; every one partitions by ``run_id`` or a finer key."""
