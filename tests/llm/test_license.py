from __future__ import annotations

import random

from conftest import table
from pyspark.sql import functions as F

from shieldframe.llm import license_scan


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/c.txt", "plain words here"),
        (3, "a/x/LICENSE", "MIT\nReleased under the MIT License."),
        (4, "a/x/y/z.txt", None),
        (5, "a/x/own.txt", "words " * 300 + "\nAll rights reserved.\n" + "words " * 300),
        (6, "q/r.txt", "see the license of nothing in particular for many other reasons"),
        (7, None, ""),
        (7, None, ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, p string, text string, license string")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from, r.speaks) for r in license_scan.scan(df, F.col("p")).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None, True), 2: (None, "Apache-2.0", "a", False), 3: ("MIT", "MIT", None, True), 4: (None, "MIT", "a/x", False),
        5: ("Proprietary", "Proprietary", None, False), 6: (None, None, None, False), 7: (None, None, None, False),
    }
    assert license_scan.scan(df, F.col("p")).count() == len(rows)
    assert license_scan.scan(df.limit(0), F.col("p")).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_a_line_scores_the_same_at_every_size_of_the_corpus(spark):
    rng = random.Random(1)
    line = "This project is released under the MIT License."
    rows = [(i, prose(rng, 50) + (f"\n{line}\n" + prose(rng, 20) if i % 20 == 0 else "")) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = {r.doc_id: (r.own_license, r.own_score) for r in license_scan.scan(df, F.lit("x/y")).collect()}
    large = {r.doc_id: (r.own_license, r.own_score) for r in license_scan.scan(df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))), F.lit("x/y")).collect()}
    assert small == large and small[0][0] == "MIT" and small[0][1] > 0.7


def test_every_template_is_found_as_itself_and_unknown_names_are_not(spark):
    rng = random.Random(2)
    every = license_scan.templates()
    rows = [(i, f"d{i}/LICENSE", f"{prose(rng, 30)}\n\n{text}\n\n{prose(rng, 30)}", licence) for i, (licence, _, text) in enumerate(every)]
    rows += [(1000 + i, f"e{i}/f", t, None) for i, t in enumerate(["Licensed under the Foo License", "Released under the terms of nothing", "see version 2.0 of the General manual"])]
    rows += [(2000 + i, "p/q", prose(rng, 60), None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string, want string")
    got = {r.doc_id: r.own_license for r in license_scan.scan(df, F.col("p")).collect()}
    assert {d: got[d] for d, _, _, want in rows if got[d] != want} == {}


def test_shuffled_input_long_texts_and_ties(spark):
    docs = table(spark, "documents", "sf0.01")
    one = license_scan.scan(docs, license_scan.document_path()).collect()
    other = license_scan.scan(docs.repartition(8, "text"), license_scan.document_path()).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, other), key=str) and sum(r.own_license is not None for r in one) > 30
    long = "word " * 60_000 + "\nLicensed under the Apache License, Version 2.0.\n" + "x" * 200_000
    rows = [(1, "a/LICENSE", "Released under the MIT License"), (2, "a/COPYING", "Released under the ISC License"), (3, "a/b", long), (4, "a/c", long), (4, "a/c", long), (5, "a/d/e", "nothing")]
    got = sorted((r.doc_id, r.own_license, r.license, r.inherited_from) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect() if r.doc_id > 2)
    assert got == [(3, "Apache-2.0", "Apache-2.0", None), (4, "Apache-2.0", "Apache-2.0", None), (4, "Apache-2.0", "Apache-2.0", None), (5, None, "ISC", "a")]


def test_the_signature_loses_nothing():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    for _ in range(200):
        template = {w: rng.random() * 7 for w in rng.sample(words, rng.randint(1, 8))}
        found = license_scan.signature([(0, w, x, False) for w, x in template.items()])
        for _ in range(50):
            unit = {w: template.get(w, rng.random() * 7) * rng.randint(1, 3) for w in rng.sample(words, rng.randint(1, 8))}
            dot = sum(x * template.get(w, 0) for w, x in unit.items())
            cosine = dot / (sum(x * x for x in unit.values()) * sum(x * x for x in template.values())) ** 0.5
            assert cosine < license_scan.LEAST_COSINE or found & unit.keys()


def test_no_python_on_the_main_path(spark):
    found = license_scan.scan(table(spark, "documents"), license_scan.document_path())
    assert "Python" not in found._jdf.queryExecution().toString()
