"""Rows, pages and texts on which an operator once did less than its whole job."""

import random

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_edges import LONG, SCHEMA

from threadhaul.llm import bpe_stream, html_region, ngram_join, secret_entropy
from threadhaul.llm.common import prepared
from threadhaul.llm.queries import BYTE_BPE, vocabulary_path

BYTES = vocabulary_path(BYTE_BPE)
DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("partitions", (1, 3))
def test_one_per_component_tells_rows_of_one_id_apart(spark, partitions):
    """Unlinked texts under one id stay; a near copy goes although its id heads another row."""
    prepared(spark)
    other = "another text under an id that is taken already by some other row"
    texts = [(1, LONG), (2, LONG + " more"), (1, other), (2, "b c d e f g h i"), (2, None), (3, other), (None, other), (4, "x y"), (4, "X y")]
    frame = spark.createDataFrame([(i, t, None, None, None, 1, "l", n) for n, (i, t) in enumerate(texts)], SCHEMA)
    got = ngram_join.one_per_component(frame.repartition(partitions))
    assert got.schema == frame.schema
    kept = sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=repr)
    want = [texts[0], texts[2], texts[3], (2, ""), texts[6], texts[7]]
    assert kept == sorted(((i, t.lower()) for i, t in want), key=repr)


BODY = "<p>First paragraph with quite some words to read in it.</p><p>Second paragraph, which holds still more words than the first one.</p>"
BODY_TEXT = "First paragraph with quite some words to read in it.\nSecond paragraph, which holds still more words than the first one."


@pytest.mark.parametrize("name", ("no-sidebar", "with-sidebar", "has-banner", "page has-comments", "side", "widget", "ad"))
@pytest.mark.parametrize("element", ("article", "main", "section"))
def test_main_text_inside_hinted_wrappers(name, element):
    """A wrapper around the content loses nothing, whatever its class or id says."""
    weights = html_region.Weights({})
    for attribute in ("class", "id"):
        page = f'<body><div {attribute}="{name}"><{element}>{BODY}</{element}></div><div class="ad">Buy now.</div></body>'
        assert html_region.extract(page, weights) == BODY_TEXT
        page = f'<body><{element}><div {attribute}="{name}">{BODY}</div><div class="ad">Buy now.</div></{element}></body>'
        assert html_region.extract(page, weights) == BODY_TEXT


def test_main_text_keeps_headings_and_no_notices_within_or_comments_behind():
    weights = html_region.Weights({})
    inner = f'<h2 id="side-effects">Effects</h2>{BODY}<h2 id="related" class="notice">Work</h2><div class="notice"><p>Mind this.</p></div>{BODY}'
    want = f"Effects\n{BODY_TEXT}\nWork\n{BODY_TEXT}"
    comments = '<div id="comments"><p>I do not agree with any of that.</p></div>'
    for page in (f"<article>{inner}{comments}</article>", f"<article>{inner}</article>{comments * 9}"):
        assert html_region.extract(f"<html><body>{page}</body></html>", weights) == want
    assert html_region.extract(f"<html><body><div>{BODY}</div>{comments}</body></html>", weights) == BODY_TEXT


@pytest.mark.parametrize("name", sorted(html_region._HINTS))
@pytest.mark.parametrize("around", ("article", "main", "section", "div"))
def test_main_text_without_hinted_elements_between_paragraphs(name, around):
    weights = html_region.Weights({})
    for attribute in ("class", "id"):
        for inner in ("<p>Buy now, or mind this.</p>", "Buy now.", "<ul><li>One more</li></ul>"):
            page = f'<{around}>{BODY}<div {attribute}="{name}">{inner}</div>{BODY}</{around}>'
            assert html_region.extract(f"<body>{page}</body>", weights) == f"{BODY_TEXT}\n{BODY_TEXT}"


def test_main_text_keeps_formulas_and_literal_text():
    weights = html_region.Weights({})
    formula = "<p>So <math><mi>x</mi><mo>&lt;</mo><mn>2</mn><annotation>x \\lt 2</annotation></math> holds.</p>"
    page = f"<article>{BODY}{formula}<xmp>if a <b> &amp; c:</xmp>{BODY}</article>"
    assert html_region.extract(page, weights) == f"{BODY_TEXT}\nSo x<2 holds.\nif a <b> &amp; c:\n{BODY_TEXT}"


def test_two_articles_on_a_page():
    """One stretch over both is the content of both; otherwise the better one counts."""
    weights = html_region.Weights({})
    both = f"<article>{BODY}</article><article>{BODY}</article>"
    assert html_region.extract(both, weights) == f"{BODY_TEXT}\n{BODY_TEXT}"
    apart = f"<article><p>Few words.</p></article><div>{'<div></div>' * 200}</div><article>{BODY}</article>"
    assert html_region.extract(apart, weights) == BODY_TEXT


def test_scan_alone_finds_the_articles_of_given_pages():
    """With article tags renamed nothing is widened: the borders are those of the scan."""
    import html
    import re
    from collections import Counter

    pages = [r["html"] for r in pq.read_table(f"{DATA}/pages.parquet", columns=["html"]).to_pylist()]
    seen = Counter()
    for page in pages[:500]:
        seen.update(html_region.label_counts(page))
    weights = html_region.Weights(seen)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        renamed = re.sub(r"(</?)article\b", r"\1div", page)
        assert html_region.extract(renamed, weights) == "\n".join(x for x in blocks if x)


def test_secrets_beside_runs_and_in_small_letters(spark):
    """A run of one character does not hide the rest of a candidate; keys need no capitals."""
    prepared(spark)
    key = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZWQyNTUxOQ"
    small = "k7q2zx9v4mw8t1ph6rj3sn5y"
    texts = [f"key {key} end", f"key={small}.", f"/{small}/", "z" * 60 + "1", "z" * 40, "z1" * 20, f"key {small[:20]} end"]
    found = secret_entropy.scan(spark.createDataFrame(list(enumerate(texts)), "n int, text string"))
    marked = found.select("n", secret_entropy.redacted(F.col("text"), F.col("all_spans")).alias("t"))
    assert [r.t for r in marked.orderBy("n").collect()] == ["key [SECRET] end", "key=[SECRET].", "/[SECRET]/", *texts[3:]]


def test_ngram_join_counts_links(spark):
    """The links of a component are at least a tree, each a true one, and both of its ends count it."""
    prepared(spark)
    rnd = random.Random(23)
    texts = []
    for _ in range(6):
        base = [f"v{rnd.randrange(3000)}" for _ in range(60)]
        for _ in range(rnd.randrange(1, 12)):
            one = list(base)
            one[rnd.randrange(60)] = f"v{rnd.randrange(3000)}"
            texts += [" ".join(one)] * rnd.randrange(1, 3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    true = brute.links(list(enumerate(texts)))
    by_component = {}
    for row in ngram_join.jaccard_components(frame).collect():
        assert row.links <= sum(row.doc_id in pair for pair in true)
        by_component.setdefault(row.component_id, []).append(row.links)
    assert any(len(x) > 2 for x in by_component.values())
    for links in by_component.values():
        assert sum(links) % 2 == 0 and sum(links) >= 2 * (len(links) - 1) and (len(links) == 1 or min(links) > 0)


def test_long_pre_tokens_are_handed_on_in_blocks():
    """No chunk grows with a pre-token, and ids and digests are those of the library."""
    machine, tokenizer, rnd = bpe_stream.Transducer(BYTES), brute.byte_tokenizer(), random.Random(29)
    for letters in ("theing", "-=_", "é한"):
        long = "".join(rnd.choice(letters) for _ in range(60_000))
        for text in (long, f"some words {long} 12 {long[:9_000]}", f" {long}\n\n" + "a b " * 5_000):
            assert max(sum(len(ids) for ids, _ in found) for found in machine.chunks(text)) <= 2 * bpe_stream.CHUNK
            assert machine.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
            assert machine.digests(text) == brute.round_trip(text)
