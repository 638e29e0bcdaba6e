from __future__ import annotations

import pytest

#: Names that some module uses itself on the way.
NAMES = """
    a again all at b block blocks body bucket bytes cell cells code content copies covered digest doc doc_key
    embedding_id family features first first_doc form found group grp h here hi how ids is_level item items key key_a
    key_b kept label2 leaf lefts length level lines lo members met mine most n n_lines n_removed n_words node number
    order_id other pack_group part payload piece place placed pos pressed rank rep rights root row row_hash rows seen
    set_code shard shift side size source_no source_size span span_doc span_tag spans spread start starts subroot tag
    taken target text_hash text_key text_rank to train_id tree unit uses visit visits w w1 w2 walls where window
    windows word word_from words
""".split()

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (id, text) or (id, text, source)."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENT_SCHEMA).repartition(3)

    return make


@pytest.fixture
def crowded():
    """The same table with columns whose names operators might use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        for name in NAMES:
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
