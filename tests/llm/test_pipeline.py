from __future__ import annotations

import duckdb
import pytest
from conftest import DATA, table
from test_decontam import brute
from test_pii import redacted
from test_simhash import fingerprint, groups
from test_toxicity import plain_score

import corpus_pipeline
from shieldframe.llm import queries, sql, toxicity

SF = f"{DATA}/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def check(spark, docs, tmp_path):
    """Every stage on all that its predecessor kept, against plain Python (mixing against its SQL)."""
    columns = docs.columns
    at = {c: i for i, c in enumerate(columns)}
    model = toxicity.fit(docs, table(spark, "labels"))
    kept = STAGES["toxicity"](spark, docs, SF).cache()
    want = [r for r in rows_of(docs) if plain_score(model, r[at["text"]]) < 0.5]
    assert kept.columns == columns and rows_of(kept) == want
    single = STAGES["simhash"](spark, kept, SF).cache()
    ids = [r[at["doc_id"]] for r in want]
    least = groups([fingerprint(r[at["text"]]) for r in want], ids)
    stay = {d for d, c in zip(ids, least, strict=True) if d == c}
    want = [r for r in want if r[at["doc_id"]] in stay]
    assert single.columns == columns and rows_of(single) == want
    clean = STAGES["decontamination"](spark, single, SF).cache()
    leaks = {d for d, _ in brute([(r[at["doc_id"]], r[at["text"]]) for r in want], [(r.item_id, r.text) for r in table(spark, "benchmark").collect()])}
    want = [r for r in want if r[at["doc_id"]] not in leaks]
    assert clean.columns == columns and rows_of(clean) == want
    safe = STAGES["pii"](spark, clean, SF).cache()
    want = sorted((tuple(redacted(v) if c == "text" else v for c, v in zip(columns, r, strict=True)) for r in want), key=str)
    assert safe.columns == columns and rows_of(safe) == want
    path = f"{tmp_path}/safe.parquet"
    safe.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    mixed = STAGES["mixing"](spark, safe, SF)
    plain = lambda r: (r[0], r[1], r[2], round(r[3], 3), r[4])
    got = sorted((plain((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in mixed.collect()), key=str)
    assert got == sorted((plain(r) for r in con.execute(f"select doc_id, size, source_size, target, taken from ({sql.MIX}) where taken > 0").fetchall()), key=str)


def test_each_stage_against_plain_python(spark, tmp_path):
    docs = table(spark, "documents").cache()
    assert list(STAGES) == ["toxicity", "simhash", "decontamination", "pii", "mixing"]
    check(spark, docs, tmp_path)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null ids, sources and texts, empty and long texts, repeated rows, and columns with the names that stages use inside."""
    docs = table(spark, "documents").limit(60).collect()
    item = table(spark, "benchmark").where("length(text) > 80").first().text
    rows = [(r.doc_id, r.text, r.lang, r.source, 0.5, "mine", 1, "b") for r in docs]
    more = [(None, None), (None, "only null has this text, ann@post.example"), (9001, None), (9002, ""), (9003, "   "), (9004, "long words go here " * 20_000), (9005, item), (9006, "dup licate text of some words")]
    rows += [(d, t, None, None if i % 2 else "s", 0.1, None, None, "c") for i, (d, t) in enumerate(more)] + [(9006, "dup licate text of some words", None, "s", 0.1, None, None, "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic_score double, pii_spans string, mix_rid int, fingerprint string")
    check(spark, df.cache(), tmp_path)
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_run_is_all_stages(spark):
    docs = table(spark, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(docs)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else v if v is None else str(v)
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
