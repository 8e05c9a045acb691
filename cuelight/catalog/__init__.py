"""The registered queries over the driver tables and their SQL oracles."""


def _load():
    from cuelight.catalog import base, outputs, ranking, relational, text  # noqa: F401

    return base


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
