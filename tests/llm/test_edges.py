"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, line_dedup, lm_scoring, near_dedup, packing, pii, quality_gam, quality_rules, spotsigs, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, _text string, _key long, spans string, n_removed long, low long, tokens string, score string, _row int"


def rows():
    body = "the cat sat on a mat and looked at the moon over the quiet hills of home " * 4
    texts = [None, "", "   ", "one", body, body, body + "again", "x" * 50_000, "call +1 (523) 555-1055 or a@b.com", "1.2.3.4 " * 500, "\n\n\n", "ab\0cd é 日本 <|endoftext|>"]
    return [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 5}", None, 9, "z", 5, "s", 1, 2, "t", "q", 3) for i, t in enumerate(texts)] + [(4, body, "en", "s1", None, 9, "z", 5, "s", 1, 2, "t", "q", 3), (None, body, None, None, None, 9, "z", 5, "s", 1, 2, "t", "q", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def apply(name, docs):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(0, 1), (4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    mark = F.col("lang") == "en"
    return {
        "packing": lambda: packing.pack_documents(docs, capacity=16),
        "gam": lambda: quality_gam.score(docs, quality_gam.fit(docs, labels), keep=("doc_id", "id", "score")),
        "lines": lambda: line_dedup.line_dedup(docs, min_sites=2),
        "bpe": lambda: bpe.bpe_encode(docs),
        "spotsigs": lambda: spotsigs.edited_likeness(docs),
        "fingerprints": lambda: spotsigs.fingerprints(docs),
        "suffix": lambda: suffix_dedup.suffix_dedup(docs),
        "pii": lambda: pii.find_pii(docs),
        "redact": lambda: pii.redact(docs),
        "rules": lambda: quality_rules.quality_rules(docs),
        "lm": lambda: lm_scoring.score(docs, mark),
        "near": lambda: near_dedup.near_duplicates(docs),
    }[name]()


NAMES = ("packing", "gam", "lines", "bpe", "spotsigs", "fingerprints", "suffix", "pii", "redact", "rules", "lm", "near")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, name):
    out = apply(name, docs).collect()
    ids = [r["doc_id"] for r in out]
    if name == "packing":
        assert sorted({str(i) for i in ids}) == sorted({str(r[0]) for r in rows()})
    else:
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, name):
    assert apply(name, docs.filter("doc_id < -5")).count() == 0


def test_other_columns_come_back(docs):
    for name in ("lines", "redact"):
        got = {(r["doc_id"], r["spans"], r["_key"], r["_row"], r["id"]) for r in apply(name, docs).collect()}
        assert got == {(r[0], "s", 5, 3, 9) for r in rows()}


def test_repeated_row_is_not_earlier_than_itself(docs):
    kept = {r["doc_id"]: r["n_removed"] for r in apply("suffix", docs).collect()}
    assert kept[4] < len(rows()[4][1]) and kept[5] == len(rows()[5][1]) and kept[None] == 0


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, sf)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(set(ids)) == counts[4]


def test_pipeline_lines_go_from_short_pages_and_copies_stay(spark, sf):
    block = ["All rights reserved by the owners of this page.", "We use cookies to make this site work for you."]
    short = [(i, "\n".join([block[0], f"own {i}", block[1]]), f"s{i}") for i in range(12)]
    copies = [(100 + i, "a page that was\ncopied as a whole", f"t{i}") for i in range(15)]
    few = [(200 + i, f"seldom seen\nown {200 + i}", f"u{i}") for i in range(9)]
    docs = spark.createDataFrame([(*r, 0) for r in [*short, *copies, *few]], "doc_id long, text string, source string, n_chars int").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    want = {i: f"own {i}" for i, _, _ in short} | {i: t for i, t, _ in [*copies, *few]}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_a_site_that_mirrors_all_texts_hides_no_boilerplate(spark):
    """A line on 31 sites in 30 texts, each of which also stands on one and the same site."""
    line = "All rights reserved by the owners of this page."
    docs = [(2 * i + k, f"{line}\nown text {i}", ("mirror", f"s{i}")[k]) for i in range(30) for k in (0, 1)]
    docs += [(1000 + i, f"nine texts\nother {i % 9}", f"t{i}") for i in range(40)] + [(2000 + i, f"nine sites\nother {i}", f"u{i % 9}") for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table).collect()}
    assert got == {i: t.removeprefix(f"{line}\n") for i, t, _ in docs}
    alone = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table, copies_vote=True).collect()}
    assert all(alone[i] == t.split("\n")[1] for i, t, s in docs if i < 2000)


def test_pipeline_near_duplicates_with_null_and_repeated_ids(spark, sf):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (2, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (None, text(3) + " more"), (7, text(4)), (7, text(5)), (8, text(5)), (3, text(6)), (9, text(7)), (9, text(6)), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    near = [x for x in got if x[1] and x[1].startswith("w3x")]
    assert len(near) == 1 and near[0] in rows
    want = [(1, text(1)), (None, text(2)), (7, text(4)), (7, text(5)), (3, text(6)), (9, text(7)), (4, None), (None, "")]
    assert sorted((x for x in got if x not in near), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with labels for the odd rows, and with none."""
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, docs, labelled, stage, empty):
    of = dict(corpus_pipeline.STAGES)[stage]
    table = docs.filter("doc_id < -5") if empty else docs
    out = of(spark, table, labelled)
    rows = out.collect()
    if stage != "packed":
        assert out.columns == docs.columns
    if empty:
        assert rows == []
    elif stage in ("lines", "personal_data"):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    else:
        assert rows


def test_pipeline_against_brute_force(spark, sf):
    """Every stage's decisions on its own input, by plain Python."""
    from tokenizers import Tokenizer

    from tessera.llm.common import tokenizer_path

    from test_exact import base_spans, exact_components

    given = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        after[name] = docs.collect()
    rows = lambda name: {r["doc_id"]: r for r in after[name]}
    before = {r["doc_id"]: r for r in given.collect()}
    model = quality_gam.fit(given, spark.read.parquet(f"{sf}/labels.parquet"))
    import numpy as np

    scores = model.scores(np.array([quality_gam.features(r["text"] or "") for r in before.values()]))
    assert set(rows("quality")) == {i for i, s in zip(before, scores, strict=True) if s >= 0.5}
    sites, texts = defaultdict(set), defaultdict(set)
    for r in rows("quality").values():
        for line in (r["text"] or "").split("\n"):
            if line.strip(" "):
                sites[line].add(r["source"] or "")
                texts[line].add(r["text"])
    for i, r in rows("quality").items():
        assert rows("lines")[i]["text"] == "\n".join(x for x in (r["text"] or "").split("\n") if min(len(sites.get(x, ())), len(texts.get(x, ()))) < 10)
    sets, component = exact_components({i: r["text"] or "" for i, r in rows("lines").items()})
    assert set(rows("near_duplicates")) == {i for i, c in component.items() if i == c}
    for i, r in rows("near_duplicates").items():
        got = rows("personal_data")[i]["text"]
        assert base_spans(got) == "" and r["n_chars"] == len(r["text"] or "")
        kept = re.split("<(?:email|ip|card|phone)>", got)
        at = 0
        for piece in kept:  # what is left stands in the text, in order
            at = r["text"].index(piece, at) + len(piece)
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    sizes, bins = defaultdict(int), defaultdict(int)
    for r in after["packed"]:
        sizes[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]] += r["length"]
    assert sizes == {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows("personal_data").items()} and max(bins.values()) <= 2048


def test_python_tasks_get_texts_in_small_batches(spark):
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('w', id, repeat(' abcdefg', 500)) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        for use in (lambda: near_dedup.signatures(docs), lambda: lm_scoring.gram_counts(docs, F.lit(True)), lambda: quality_gam.score(docs, quality_gam.Gam())):
            spark.conf.set(name, default)
            use()
            assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5 << 20
        spark.conf.set(name, f"{1 << 20}b")  # a session's own limit stays
        near_dedup.signatures(docs)
        assert spark.conf.get(name) == f"{1 << 20}b"
    finally:
        spark.conf.unset(name)
