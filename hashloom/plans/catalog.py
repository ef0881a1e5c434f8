"""The queries of the library's own operators, with their SQL."""

from . import books, codes, content, datasets, dialogue, images, index, stores, streams, texts, vectors


def queries() -> dict:
    return vectors.QUERIES | texts.QUERIES | codes.QUERIES | dialogue.QUERIES | content.QUERIES | index.QUERIES | stores.QUERIES | streams.QUERIES | images.QUERIES | books.QUERIES | datasets.QUERIES


def oracle_sql() -> dict:
    return vectors.SQL | texts.SQL | codes.SQL | dialogue.SQL | content.SQL | index.SQL | stores.SQL | streams.SQL | images.SQL | books.SQL | datasets.SQL
