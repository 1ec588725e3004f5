"""Each operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tidelog.llm import byte_bpe, decontaminate, language_id, line_dedup, lm_score, quality, secrets, simhash_dedup, url_filter, warc
from tidelog.llm import queries as registered

LONG = "word " * 30_000 + "Ünïcödé\n" * 50
DOCS = [
    (1, "A clean text of some words that stands alone here, and goes on for long enough to count as one.", "en", "s1", 1),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, LONG, "de", "s1", 5),
    (5, "12 34 !!", "fr", None, 3),
    (None, "A text without an id that is long enough to be kept by the rules on twenty words, as it has more than those.", "en", "s2", 9),
    (7, "x", None, "s2", 1),
    (8, "tie tie tie", "en", "s1", 1),
    (8, "tie tie tie", "en", "s1", 1),
    (9, "tie tie tie", "en", "s1", 1),
]
EXTRA = ("id", "mark", "fp", "n", "h", "line", "w", "start", "removed", "kept", "key", "root", "host", "verdict", "base", "block")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same " * 400
    rows = [(1, "http://A.example.net/x?q", big), (2, "http://b.example.org/es/1", big), (3, None, None), (4, "no scheme", ""), (5, "ftp://c.example.com", "<a href=http://bad.example.com/1>"), (6, "http://bad.example.com/de/9", "y"), (6, "http://bad.example.com/de/9", "y"), (None, "http://z.net/", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "host", "path", "rule", "sha256", "payload", "header", "n_bytes")})


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ITEMS = "item_id long, text string"
BY_DOCS = {
    "op1": lambda d: byte_bpe.op1_query(d, RANKS, public_tokenizers.PATTERN),
    "op2": language_id.op2_query,
    "op3": simhash_dedup.op3_query,
    "op4": quality.op4_query,
    "op6": secrets.op6_query,
    "op7": line_dedup.op7_query,
    "op9": lm_score.op9_query,
}


@pytest.mark.parametrize("name", BY_DOCS)
def test_one_row_each(docs, name):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in BY_DOCS[name](docs).collect()) == sorted((r[0] is None, r[0] or 0) for r in DOCS)


@pytest.mark.parametrize("name", BY_DOCS)
def test_empty_table(docs, name):
    assert BY_DOCS[name](docs.where("false")).collect() == []


def test_defined_results(docs):
    of = lambda name: {r["doc_id"]: r.asDict() for r in BY_DOCS[name](docs).collect()}
    assert of("op1")[2]["n_tokens"] == 0 and of("op2")[5]["lang_pred"] == "und" and of("op2")[2]["lang_pred"] == "und"
    three = of("op3")
    assert three[2]["fingerprint"] == "0" * 16 and three[3]["component_id"] == 2 and three[9]["component_id"] == 8
    four = of("op4")
    assert not four[2]["kept"] and four[1]["kept"] and four[4]["n_repeat_words"] == 30_050
    seven = of("op7")
    assert (seven[9]["n_removed"], seven[2]["n_lines"], seven[3]["n_lines"]) == (1, 0, 1)
    assert sorted(r["n_removed"] for r in BY_DOCS["op7"](docs).where("doc_id = 8").collect()) == [0, 1]  # one of two equal rows keeps its line
    assert sorted(r["text"] for r in line_dedup.dedup_lines(docs).where("doc_id in (8, 9)").collect()) == ["", "", "tie tie tie"]
    nine = of("op9")
    assert nine[2]["n_tokens"] == nine[3]["n_tokens"] == 1


def test_leaks_edges(spark, docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, DOCS[0][1]), (3, DOCS[0][1]), (4, "x"), (None, "tie tie tie")], ITEMS).withColumn("len", F.lit(1))
    got = sorted((r["doc_id"], r["item_id"] or 0) for r in decontaminate.op8_query(docs, items).collect())
    assert got == [(1, 3), (7, 4)]  # items without an id are left out
    assert decontaminate.op8_query(docs, items.where("false")).collect() == [] == decontaminate.op8_query(docs.where("false"), items).collect()
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns


def test_pages_edges(pages):
    five = {r["page_id"]: r.asDict() for r in url_filter.op5_query(pages).collect()}
    assert (five[3]["host"], five[3]["path"], five[4]["host"]) == ("", "", "") and five[1]["host"] == "a.example.net" and five[2]["verdict"] == "block" and five[5]["verdict"] == "block"
    ten = [r.asDict() for r in warc.op10_query(pages).collect()]
    assert len(ten) == 8 and all(r["intact"] for r in ten)
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in ten} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    assert url_filter.op5_query(pages.where("false")).collect() == [] == warc.op10_query(pages.where("false")).collect()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, docs, tmp_path, k):
    spark.createDataFrame([(1, "no such words in any of these texts at all")], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns, name
    kept = {r["doc_id"] for r in out.collect()}
    assert 1 in kept and (None in kept), name
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_one_query_each():
    assert {q.split("_")[0] for q in registered.QUERIES} == {f"op{n}" for n in range(1, 11)}
