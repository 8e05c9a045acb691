"""Operators for training-data pipelines over documents and pages; nothing else in the library imports them."""


def _load():
    from cuelight.llm import (  # noqa: F401
        html_blocks,
        licenses,
        line_quality,
        line_windows,
        manifest,
        mixing,
        ngram_join,
        order_minhash,
        packing,
        pieces,
        ranked_search,
        substring,
        tables,
        toxicity,
    )

    return tables


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
