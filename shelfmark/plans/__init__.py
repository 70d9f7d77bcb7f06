from .organise import cluster_records, execute, organise, undo_and_report  # noqa: F401
