"""Columns with the names that operators use, many spans in one text, ids told apart."""

from collections import Counter

import numpy as np

from ledgerlake.llm import ann, pieces, pii, quality_rules, secrets, toxicity
from ledgerlake.llm.spans import quoted


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org now", 7, "s", 2.0, "t", 3), (None, None, 8, "u", 4.0, "v", 5)], "doc_id long, text string, _email int, spans string, Toxicity double, ids string, n_tokens int")
    clean = pii.redact(df).collect()
    assert pii.redact(df).columns == df.columns and {tuple(r)[2:] for r in clean} == {(7, "s", 2.0, "t", 3), (8, "u", 4.0, "v", 5)}
    assert "input_spans" in pii.scan(df).columns and "input_spans" in secrets.scan(df, secrets.Model([0.0] * 4096, 0.0)).columns
    scored = toxicity.score(df, toxicity.Model(prior=0.25))
    assert {(r["input_Toxicity"], r["toxicity"]) for r in scored.collect()} == {(2.0, 0.25), (4.0, 0.25)}
    encoded = pieces.encode(df, pieces.load())
    assert {(r["input_ids"], r["input_n_tokens"], r["ids"] is None) for r in encoded.collect()} == {("t", 3, False), ("v", 5, True)}


def test_many_spans_in_one_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"a{i}@b.co" for i in range(5000)))], "doc_id long, text string")
    row = pii.redact(df).first()
    assert row["text"] == " ".join(["[EMAIL]"] * 5000)


def test_random_tokens_touched_by_known_spans(spark):
    key = "qWzXvBnMkLjHgFdSaPoIuYtReWq"
    model = secrets.Model([1.0] * 4096, 5.0)
    df = spark.createDataFrame([(1, f"{key} token={key} {'ab' * 20}"), (2, f"x {key}")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in secrets.scan(df, model).collect()}
    assert got == {1: [("random", 0), ("assign", 28), ("hex", 62)], 2: [("random", 2)]}


def test_lines_above_the_limits_go(spark):
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'z' * k}" for k in range(12))
    rows = [(str(i), own(i) + "\nThe shared   line 7 of all", "h", 1) for i in range(30)]
    got = quality_rules.clean(spark.createDataFrame(rows, "doc_id string, text string, source string, row int")).collect()
    assert Counter((r["doc_id"], r["text"], r["row"]) for r in got) == Counter((str(i), own(i), 1) for i in range(30))


def test_rows_of_one_vec_id_are_each_a_query(spark):
    x = np.random.RandomState(0).rand(40, 4)
    rows = [(100 if i < 2 else i, x[i].tolist()) for i in range(40)]
    index, books = ann.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), m=4, k=16)
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(index, books, index.where("vec_id % 100 = 0")).collect())
    want = Counter()
    for q in (0, 1):
        near = sorted((round(float(np.sqrt(((x[i] - x[q]) ** 2).sum())), 9), rows[i][0]) for i in range(40) if i != q)[:10]
        want.update((100, k + 1, v, s) for k, (s, v) in enumerate(near))
    assert got == want


def test_quoted(spark):
    text = "a\\b'c\"\\d"
    assert spark.sql(f"select {quoted(text)}").first()[0] == text
