"""Registered queries against their DuckDB oracles on small tables of odd texts."""

import duckdb
import pytest

from folioscope import catalogue


@pytest.fixture
def differences(spark, tmp_path):
    """Rows that a query and its oracle don't share, for one table given as rows and their schema."""

    def run(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in want.description]
        got = catalogue.queries()[name](spark, str(tmp_path)).select(*names)
        plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
        return plain(got.collect()), plain(want.fetchall())

    return run


def turns(*texts):
    return [(c, t, "user", x) for c, pair in enumerate(texts) for t, x in enumerate(pair if isinstance(pair, tuple) else (pair,))], "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["intent_weights", "entity_mentions", "question_keys"])
def test_words_beside_letters_beyond_ascii(differences, name):
    got, want = differences(name, "conversations", *turns("den inöauen", "éthe", "theé of_ in9", "İN", "THIS İN ΟΔΟΣ", "ofthe", None, ""))
    assert got == want


def test_tickers_beside_letters_beyond_ascii(differences):
    got, want = differences("gap_grounding", "conversations", *turns(("ñ", "öEU, USé and UK_"), ("EU", "éEU API"), (None, "EU")))
    assert got == want


ODD = ["0 zero. One 1\nis 12. 3  \n 4 lead", "x \n y. 　", " a | 1\n b |c 2", " \n\t\n  ", " First\nsecond", *["　Head\n" * 5 + "Head "], None, ""]


@pytest.mark.parametrize("name", ["sentence_split", "running_headers", "row_labels"])
def test_spaces_and_digits_at_the_ends_of_lines(differences, name):
    got, want = differences(name, "documents", list(enumerate(ODD)), "doc_id long, text string")
    assert got == want


@pytest.mark.parametrize("name", ["prompt_fences", "question_keys"])
def test_spaces_at_the_ends_of_turns(differences, name):
    got, want = differences(name, "conversations", *turns(*ODD))
    assert got == want


def test_digits_stay_in_sentences(spark):
    from pyspark.sql import functions as F

    from folioscope.operators import structure

    assert spark.range(1).select(structure.sentences(F.lit("0 a 0. b1\n 22. ")).alias("s")).first().s == ["0 a 0.", "b1", "22."]


def test_shares_of_odd_turns(differences):
    got, want = differences("quote_token_share", "conversations", *turns((None, "a b c"), ("a b c", None), ("", "a b c"), ("a  b", "a b c a"), ("x a b c c a", "A b|c C"), ("c a x a b a c", "a b c"), ("İ a b", "i a b")))
    assert got == want and len(got) == 6


def test_a_long_excerpt_is_gone_through_once(spark):
    from time import monotonic

    from pyspark.sql import functions as F

    from folioscope.operators import checks

    words = [f"w{i}" for i in range(10_000)]
    pair = spark.createDataFrame([(" ".join(words[::2]), " ".join(words * 2))], "q string, t string").select(checks.token_share(F.col("q"), F.col("t")).alias("x"))
    start = monotonic()
    assert pair.first().x == 0.5 and monotonic() - start < 60
