"""Every operator on tables with nulls, repeated rows, empty tables, and extra columns named like its own."""

import pytest

from thicket.llm.bm25_search import search
from thicket.llm.chat_quotes import link_quotes
from thicket.llm.jaccard_join import jaccard_classes, keep_one
from thicket.llm.mixing import mix
from thicket.llm.packing import pack_documents
from thicket.llm.quality_rules import QualityModel, judge
from thicket.llm.substring_dedup import dedup, dedup_digest
from thicket.llm.tokens import token_counts
from thicket.llm.url_filter import filter_urls
from thicket.llm.warc import archive_pages

DOCS = "doc_id long, text string, source string"
PAGES = "page_id long, url string, html string, bad boolean"
TURNS = "conv_id long, turn long, role string, text string"
LONG = " ".join(f"w{i}" for i in range(60))
DOC_ROWS = [(1, LONG, "a"), (1, LONG, "a"), (2, LONG + " z", None), (None, LONG, "b"), (None, None, None), (3, "", "a"), (4, " \t", "b"), (5, "one two", "b"), (6, "long " * 20_000, "a")]
PAGE_ROWS = [(1, "http://a.org/x/1", "h" * 200, True), (1, "http://a.org/x/1", "h" * 200, True), (2, None, "h" * 200, None), (None, "b", None, None), (3, "http://a.org", "", False)]
TURN_ROWS = [(1, 1, "u", "hello there"), (1, 2, "v", "> hello there\nyes"), (1, 2, "v", "> hello there\nyes"), (None, 1, None, "> x"), (2, None, "u", None), (2, 1, None, "")]

LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "jaccard_classes": (DOCS, DOC_ROWS, jaccard_classes, "n_shingles component_id fid fp tk root token key gid"),
    "keep_one": (DOCS, DOC_ROWS, keep_one, "fp root place chosen_fp c0 c1"),
    "warc": (PAGES, PAGE_ROWS, lambda t: archive_pages(t).drop("file"), "payload digest size refers time run offset fetched_at record_type"),
    "url_filter": (PAGES, PAGE_ROWS, filter_urls, "host path shape seg template n labelled blocked verdict"),
    "mix": (DOCS, DOC_ROWS, mix, "n_tokens epoch block mix_order blocks passes rest budget c0"),
    "search": (DOCS, DOC_ROWS, lambda t: search(t, t), "row shard role terms weights term df words rank score query_id"),
    "token_counts": (DOCS, DOC_ROWS, token_counts, "n_bytes n_tokens over_limit"),
    "judge": (DOCS, DOC_ROWS, lambda t: judge(t, t.sparkSession.createDataFrame([(5, 1, 0), (None, 1, None)], LABELS)), "n_words score kept base_failed bucket corpus target"),
    "quality_kept": (DOCS, DOC_ROWS, lambda t: QualityModel(t, None).kept(t), "n_words score kept"),
    "packing": (DOCS, DOC_ROWS, pack_documents, "start length offset sequence_id spans loss_tokens"),
    "dedup_digest": (DOCS, DOC_ROWS, dedup_digest, "key spans n_words n_removed first last anchor c0"),
    "dedup": (DOCS, DOC_ROWS, dedup, "key spans c0 c1 c2"),
    "link_quotes": (TURNS, TURN_ROWS, link_quotes, "thread reply_to depth n_quoted n_linked own quotes origin level lines key"),
}


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, name):
    schema, rows, run, extra = OPERATORS[name]
    plain = run(spark.createDataFrame(rows, schema).coalesce(1))
    extra = extra.split()
    wide = spark.createDataFrame([(*r, *[None if i % 3 else f"x{i}" for i in range(len(extra))]) for r in rows], ", ".join([schema, *[f"{c} string" for c in extra]]))
    out = run(wide.coalesce(1))
    # What passes rows through keeps the extra columns; its own come at the end in the same order.
    own = plain.columns if out.columns == plain.columns else [c for c in plain.columns if c in schema]
    assert rows_of(out, own) == rows_of(plain, own)
    if out.columns != plain.columns:
        assert set(extra) <= set(out.columns) and len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    schema, _, run, extra = OPERATORS[name]
    assert run(spark.createDataFrame([], ", ".join([schema, *[f"{c} int" for c in extra.split()]]))).collect() == []
