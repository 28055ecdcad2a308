"""DataFrame operators; every table carries its sample_id."""
