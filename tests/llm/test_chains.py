"""The mixing queue in plain Python, languages by text alone, and the pipeline's chain on odd input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from ledgerlens.llm import catalog, langid
from ledgerlens.llm.common import read, write_once


def plain_queue(rows, epochs=3):
    """``taken`` of each row of the mix (doc_id, source, size, source_size, target), by building and serving the whole queue."""
    by_source = defaultdict(list)
    for k, (doc_id, source, size, _, target) in enumerate(rows):
        key = hashlib.md5((f"mix:{doc_id}" if doc_id is not None else "mix").encode()).hexdigest()
        by_source[source].append((key, doc_id is None, doc_id or 0, size, k))
    place, copies = 0, []
    for source in sorted(by_source, key=lambda s: (s is None, s)):
        at = 0
        for _, _, _, size, k in sorted(by_source[source]):
            place += 1
            at += size
            whole, target = rows[k][3], rows[k][4]
            if size and target:
                copies += [((whole * e + at) / target, place, e, size, k) for e in range(epochs) if whole * e + at - size < target]
    budget, taken = sum(r[2] for r in rows), Counter()
    for _, _, _, size, k in sorted(copies):
        taken[k] += min(size, budget)
        budget -= min(size, budget)
    return [taken[k] for k in range(len(rows))]


def test_mix_equals_the_plain_queue(spark, folder, edge_docs):
    from ledgerlens.llm import fairmix

    for found in (catalog.QUERIES["op3_fair_mix"](spark, folder).collect(), fairmix.fair_mix(edge_docs.dropDuplicates(["doc_id"])).collect()):
        assert [r.taken for r in found] == plain_queue([(r.doc_id, r.source, r.size, r.source_size, r.target) for r in found])


def test_language_of_the_text_alone(spark):
    """Without declaration, suffix and host the text likelihoods name nearly every document's language."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = langid.model_of(docs)
    alone = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "lang AS truth").filter("truth IS NOT NULL AND length(text) > 40")
    truth = {r.doc_id: r.truth for r in alone.collect()}
    found = {r.doc_id: r.lang for r in langid.document_languages(alone.drop("truth"), model).collect()}
    assert sum(found[k] == t for k, t in truth.items()) >= 0.99 * len(truth)


def chained(spark, docs, folder):
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = write_once(stage(spark, docs, folder))
        sizes[name] = docs.count()
    return sizes, docs


def test_chain_on_an_empty_table(spark, folder, no_docs):
    sizes, last = chained(spark, no_docs, folder)
    assert set(sizes.values()) == {0} and "exact" in last.columns


def test_chain_on_odd_rows(spark, folder, edge_docs):
    sizes, last = chained(spark, edge_docs, folder)
    rows = last.collect()
    assert rows and all(r.exact and r.n_ids == len(r.ids) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in edge_docs.collect()}


def test_chain_on_null_texts(spark, folder, edge_docs):
    docs = edge_docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    _, last = chained(spark, docs, folder)
    assert all(r.exact and not r.ids for r in last.collect())
