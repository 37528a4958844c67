"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Every whole text is cut into units: its sentences and lines, its paragraphs (which a header is), and the whole (which a
licence file is). Units are compared with every template by the cosine of their TF-IDF vectors. Weights are made of the
shares of all documents that have a word, for all words, so a unit's cosine doesn't change with the size of the corpus.
A template that names its licence also needs the name's words. A document of which a matching unit makes up a large
part, or whose file has a licence file's name, speaks for its directory. Files without a licence of their own take that
of the nearest directory above them that has one: directories are reduced to distinct ones first, their ancestors are
joined by path, and files are joined to the result.

What can match is found without loss: a unit can only reach the least cosine if it has a word among a template's
heaviest ones, those beyond which too little of the template's squared length is left. Equal texts and equal units are
scored once, by their digests, so rows need no number of their own. SQL functions only; what is broadcast has a row per
template word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.license_texts import templates
from shieldframe.llm.scratch import attach, checkpoint, stored

LEAST_COSINE = 0.6
LEAST_SHARE = 0.2
#: Words in fewer than about this share of all documents all weigh the same.
RARE = 0.001
CUT = r"[.;!?][ \t\r\n]+|\n+"
PARAGRAPH = r"\n[ \t\r]*\n"
BETWEEN = "[^a-z0-9]+"
FILE_NAMES = r"(?i)^(?:licen[sc]e|copying|notice)(?:[.][a-z]+)?$"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


def template_words() -> list[tuple[int, str, str, int, bool, int]]:
    """(template, licence, word, times, whether it must occur, number of words that must) of every template."""
    out = []
    for t, (licence, must, text) in enumerate(templates()):
        words, needed = words_of(text), set(words_of(must))
        out += [(t, licence, w, words.count(w), w in needed, len(needed)) for w in sorted(set(words) | needed)]
    return out


def _words(low: Column) -> Column:
    return F.array_remove(F.split(low, BETWEEN), "")


def idf(share: Column) -> Column:
    """The weight of a word that `share` of all documents have: 0 where all have it."""
    return F.log((1 + RARE) / (share + RARE))


def _weight(times: Column) -> Column:
    return 1 + F.log(times)


def any_of(words: Iterable[str]) -> str:
    """A pattern that finds any of the words; common beginnings are tried once."""

    def branch(tails: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for t in tails:
            by_first.setdefault(t[:1], []).append(t[1:])
        parts = [c + branch(rest) if c else "" for c, rest in sorted(by_first.items(), reverse=True)]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return f"(?<![a-z0-9]){branch(sorted(set(words)))}(?![a-z0-9])"


def signature(weights: list[tuple[int, str, float, bool]], least: float = LEAST_COSINE) -> set[str]:
    """Words of which every matching unit has one. weights: (template, word, weight, must).

    A unit's cosine to a template is at most the part of the template's length that lies in common words. So of a
    template's words in order of weight, those from which on less than `least` squared is left needn't be looked for.
    Where a template has words that must occur, its heaviest such word is enough.
    """
    out: set[str] = set()
    by: dict[int, list[tuple[float, str, bool]]] = {}
    for t, w, x, must in weights:
        by.setdefault(t, []).append((x, w, must))
    for rows in by.values():
        needed = [(x, w) for x, w, must in rows if must]
        if needed:
            out.add(max(needed)[1])
            continue
        rows.sort(reverse=True)
        left = total = sum(x * x for x, _, _ in rows)
        for x, w, _ in rows:
            if left < least * least * total * (1 - 1e-9):
                break
            out.add(w)
            left -= x * x
    return out


def _units(low: Column) -> Column:
    return F.concat(F.split(low, CUT, -1), F.split(low, PARAGRAPH, -1), F.array(low))


def match_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, path, text) to rows (doc_id, path, h: the text's digest), and what the texts match: (h, own_license,
    own_score, share, n_matches), a row per digest that matches anything.

    The own licence is that of the unit with the highest cosine (rounded to 6 places), then the first unit, then the
    first template. share is the part of the document's words that its longest matching unit has; n_matches counts the
    different matching units.
    """
    spark = docs.sparkSession
    low = F.lower(F.coalesce("text", F.lit("")))
    n_docs = docs.count()
    seen = docs.select(F.explode(F.array_distinct(_words(low))).alias("word")).groupBy("word").agg(F.count("*").alias("having"))
    shares = stored(seen.select("word", idf(F.col("having") / F.lit(max(1, n_docs))).alias("idf")), "word-weights")
    every = F.broadcast(spark.createDataFrame(template_words(), "template int, license string, word string, times int, must boolean, n_must int"))
    rare = idf(F.lit(0.0))
    # shares is read once, filtered by the template words that are broadcast
    found = shares.join(every.select("word").distinct().hint("broadcast"), "word", "left_semi")
    weights = {r["word"]: r["idf"] for r in found.collect()}  # at most a row per template word
    table = every.join(F.broadcast(spark.createDataFrame(list(weights.items()), "word string, idf double")), "word", "left")
    table = table.withColumn("y", _weight(F.col("times")) * F.coalesce("idf", rare)).where("times > 0 or must")
    table = checkpoint(table.select("template", "license", "word", F.when(F.col("times") > 0, F.col("y")).otherwise(0.0).alias("y"), "must", "n_must"))
    rows = table.collect()
    hints = any_of(signature([(r["template"], r["word"], r["y"], r["must"]) for r in rows]))
    marked = docs.select("doc_id", "path", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.when(low.rlike(hints), F.col("text")).alias("text"))
    marked = stored(marked, "marked")
    texts = marked.where("text is not null").groupBy("h").agg(F.first("text").alias("text")).select("h", F.lower("text").alias("low"))
    units = texts.select("h", F.size(_words(F.col("low"))).alias("doc_words"), F.posexplode(_units(F.col("low"))).alias("pos", "unit"))
    units = units.where(F.col("unit").rlike(hints)).withColumn("k", F.md5("unit"))
    units = stored(units.select("h", "doc_words", "pos", "k", "unit"), "units")
    one = units.groupBy("k").agg(F.first("unit").alias("unit")).select("k", F.explode(_words(F.col("unit"))).alias("word"))
    counted = one.groupBy("k", "word").agg(F.count("*").alias("tf"))
    weighed = checkpoint(attach(counted, shares, "word", F.col("k")).select("k", "word", (_weight(F.col("tf")) * F.col("idf")).alias("x"), "tf"))
    lengths = weighed.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sum("tf").alias("n_words"))
    of_template = table.groupBy("template").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("t_length"))
    words = F.broadcast(table.join(of_template, "template").where("t_length > 0"))
    sums = weighed.join(words, "word").groupBy("k", "template", "license", "t_length", "n_must").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("must").cast("int")).alias("have"))
    scored = sums.where("have = n_must").join(lengths.where("length > 0"), "k").withColumn("score", F.round(F.col("dot") / (F.col("length") * F.col("t_length")), 6))
    best = scored.where(F.col("score") >= LEAST_COSINE).groupBy("k").agg(F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("b"), F.max("n_words").alias("n_words"))
    placed = attach(units.select("h", "doc_words", "pos", "k"), best, "k", F.col("h"))
    per_text = placed.groupBy("h", "doc_words").agg(F.max(F.struct("b.score", (-F.col("pos")).alias("p"), "b.t", "b.license")).alias("b"), F.max("n_words").alias("n"), F.count_distinct("k").alias("n_matches"))
    share = F.round(F.col("n") / F.col("doc_words"), 6)
    matches = per_text.select("h", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"), share.alias("share"), "n_matches")
    return marked.select("doc_id", "path", "h"), matches


def inherit(files: DataFrame) -> DataFrame:
    """files (path, dir, own_license, own_score, speaks, ...): adds license and inherited_from.

    A directory's licence is that of its speaking file with the highest score, then the least licence id. Paths are
    separated by single slashes; the empty path is the root, above all.
    """
    top = F.min(F.struct((-F.col("own_score")).alias("s"), "own_license"))
    owner = files.where("speaks and own_license is not null").groupBy(F.col("dir").alias("above")).agg(top.alias("top")).select("above", F.col("top.own_license").alias("dir_license"))
    dirs = files.select("dir").distinct()
    depth = F.size(F.split("dir", "/", -1))
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(F.split("dir", "/", -1), F.lit(1), n), "/").alias("above")))
    pairs = dirs.where("dir != ''").select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    pairs = pairs.union(dirs.where("dir = ''").select("dir", F.lit(0).alias("depth"), F.col("dir").alias("above")))
    # the root and other directories near it are above very many: their rows are dealt to many tasks
    nearest = attach(pairs, owner, "above", F.col("dir")).groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n"))
    nearest = nearest.select("dir", F.col("n.above").alias("from_dir"), F.col("n.dir_license").alias("dir_license"))
    out = attach(files, nearest, "dir", F.col("path"), how="left")
    return out.withColumn("license", F.coalesce("own_license", "dir_license")).withColumn("inherited_from", F.when(F.col("own_license").isNull(), F.col("from_dir"))).drop("from_dir", "dir_license")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, path, own_license, own_score, n_matches, speaks, license, inherited_from.

    Null and empty texts have no licence of their own; a null path is in the root. Repeated rows stay. Licences that
    aren't found are null, with an own_score of 0. Ties go to the first unit, the first template, and between files of a
    directory to the least licence id. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    own, found = match_texts(rows)
    name = F.substring_index("path", "/", -1)
    dir_ = F.when(F.instr("path", "/") > 0, F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise(F.lit(""))
    joined = attach(own, found, "h", F.concat_ws("/", "path", "doc_id"), how="left")
    speaks = F.col("own_license").isNotNull() & (name.rlike(FILE_NAMES) | (F.col("share") >= LEAST_SHARE))
    files = checkpoint(joined.select("doc_id", "path", dir_.alias("dir"), "own_license", F.coalesce("own_score", F.lit(0.0)).alias("own_score"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce(speaks, F.lit(False)).alias("speaks")))
    return inherit(files).select("doc_id", "path", "own_license", "own_score", "n_matches", "speaks", "license", "inherited_from")


def document_path(source: str = "source", lang: str = "lang", doc_id: str = "doc_id") -> Column:
    """A path for rows that have none: source/lang/hundreds of the id/id.txt."""
    return F.concat_ws("/", F.coalesce(F.col(source), F.lit("none")), F.coalesce(F.col(lang), F.lit("none")), F.expr(f"cast({doc_id} div 100 as string)"), F.concat(F.col(doc_id).cast("string"), F.lit(".txt")))
