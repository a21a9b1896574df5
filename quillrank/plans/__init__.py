"""Query plans: corpus builders, the registered queries and their DuckDB oracles."""


def load_all():
    """Import every query module (each registers itself) and return the registry."""
    from quillrank.plans import registry
    from quillrank.plans import q_features, q_model, q_reports, q_search, q_tables  # noqa: F401
    return registry
