"""The pipeline's stages: what each keeps, drops and changes, and all of them over real tables."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline as P
from larkspur.llm import queries

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(3, 8)))
    rows = []
    for i in range(300):
        text = " ".join([word() for _ in range(r.choice([4, 30, 90]))] + ["stupid", "fool", "idiot"] * (i % 5 == 0))
        rows.append([i, text, "aa", f"s{i % 3}", len(text)])
    rows += [[400, rows[1][1] + " more", "aa", "s", 9], [401, None, "aa", "s", 0], [402, rows[2][1] + " a.b@c.org", None, None, None], [403, "42", "aa", "s", 2], [3, rows[3][1], "aa", "s0", 9]]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), None) for i in range(250)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    calm = P.drop_toxic(spark, docs, folder)
    assert calm.columns == docs.columns
    kept = {r.doc_id for r in calm.collect()}
    assert not {i for i in kept if i < 300 and i % 5 == 0} and {i for i in range(300) if i % 5} <= kept
    known = P.keep_known_languages(spark, calm, folder)
    assert {r.doc_id for r in known.collect()} == kept - {401, 403}
    one = P.keep_one_of_each_group(spark, known, folder)
    ids = sorted(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and len(ids) == len(set(ids))
    gone = kept - {401, 403} - set(ids)
    assert all(i >= 300 for i in gone)  # the first of each group stays
    safe = {r.doc_id: r for r in P.redact_personal_data(spark, one, folder).collect()}
    assert all("@" not in r.text for r in safe.values())
    packed = P.pack_sequences(spark, one, folder)
    assert sorted({r.doc_id for r in packed.collect()}) == ids
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_stages_keep_columns_of_any_name(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS _score", "2 AS _predicted", "'x' AS _lang", "true AS _rejected", "3 AS _number", "4 AS component_id", "5 AS class")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[5:] == ["_score", "_predicted", "_lang", "_rejected", "_number", "component_id", "class"]
        assert docs.select("_score", "_predicted", "_lang", "_rejected", "_number").distinct().collect() == [(1, 2, "x", True, 3)]


def test_run_equals_the_stages_in_turn(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id, r.piece, r.length)
    assert sorted(map(key, docs.collect())) == sorted(map(key, P.run(spark, folder).collect()))


def test_run_equals_plain_loops(spark, corpus, tmp_path):
    """What is kept, merged, redacted and packed, worked out row by row with the fitted models."""
    from test_joins import brute_groups
    from tokenizers import Tokenizer

    from larkspur.llm import common as C
    from larkspur.llm import language_id, pii, toxicity

    folder, rows = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    judge, hasher = toxicity.learn(docs, labels, lambda i: ~C.held_out(i)), toxicity.Hasher(20)
    left = [r for r in rows if judge.scores([hasher.buckets(r[1])])[0] < 0.5]
    calm = spark.createDataFrame(left, SCHEMA)
    speaks = language_id.learn(calm, language_id.not_held_out)
    left = [r for r in left if not speaks.predict([r[1]], language_id.Fit().dims)[2][0]]
    first = {i: c for i, _, c in brute_groups([(r[0], r[1]) for r in left])}
    left = {r[0]: r for r in sorted(left, key=lambda r: r[1], reverse=True) if first[r[0]] == r[0]}
    assert 200 < len(left) < 260
    tokenizer, want = Tokenizer.from_file(P.tokenizer_path("word_bpe_49k.json")), {}
    for i, (_, text, *_) in left.items():
        base = pii.base_spans(text)
        for a, kind, b in sorted([*base, *pii.added_spans(pii.trained(), [text], [base])[0]], reverse=True):
            text = text[:a] + f"[{pii.KINDS[kind].upper()}]" + text[b:]
        want[i] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    P.store(spark, folder, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.length for r in got} == want and all((r.piece, r.start) == (0, 0) for r in got)
    for name in {r.sequence_id for r in got}:
        some, end = sorted((r.offset, r.length) for r in got if r.sequence_id == name), 0
        for offset, length in some:
            assert offset == end
            end += length
        assert end <= 4096
    assert len({r.sequence_id for r in got}) == -(-sum(want.values()) // 4096)
    assert C.release(spark) == 0


def test_extra_columns_without_an_order(spark, corpus):
    """A map beside rows that share an id."""
    folder, rows = corpus
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "map('k', source) AS extra", "array(lang) AS more")
    one = P.keep_one_of_each_group(spark, docs, folder).collect()
    assert len(one) == len({r.doc_id for r in one}) and {r.doc_id for r in one} > {3, 7}


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_every_query_runs_over_whole_tables(spark, name):
    run = P.run if name == "pipeline" else queries.queries()[name]
    got = run(spark, str(DATA))
    n = got.count()
    if name in queries.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(queries.oracle_sql()[name])
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    else:
        assert n > 0
