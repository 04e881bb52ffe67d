"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing names; queries against SQL or brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import catalog, covertree, fairmix, icws, langid, licenses, linetree, pieces, repair, simhash, toxicity, words
from ledgerlens.llm.common import components, read, running_totals, write_once

OPERATORS = {
    "repair": repair.id_digest,
    "simhash": simhash.fingerprint_documents,
    "fair_mix": fairmix.fair_mix,
    "mixed_rows": fairmix.mixed_rows,
    "language": langid.document_languages,
    "accepted": langid.accepted_documents,
    "line_dedup": linetree.line_dedup,
    "near_copies": icws.near_copies,
    "representatives": icws.representatives,
    "token_digest": pieces.token_digest,
    "checked_ids": pieces.checked_ids,
    "licenses": licenses.license_spans,
}


def rows_by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).count() == 0


def test_empty_tables_of_the_others(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_products(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.page_languages(pages, langid.Model(["en"], np.ones((1, 1 << langid.BUCKET_BITS)))).count() == 0


def edge_rows(edge_docs):
    return [(r.doc_id, r.text or "", r.source) for r in edge_docs.select("doc_id", "text", "source").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def check_ids(rows, found):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, wanted = 0, []
    for doc_id, text, *_ in in_order(rows):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=repr) == sorted(wanted, key=repr)


def test_repair_edges(edge_docs):
    check_ids(edge_rows(edge_docs), repair.id_digest(edge_docs).collect())


def test_repair_query(spark, folder):
    docs = read(spark, folder, "documents")
    check_ids([(r.doc_id, r.text or "") for r in docs.collect()], catalog.QUERIES["op1_repair"](spark, folder).collect())


def test_repair_files_serve_single_documents(spark, folder, tmp_path):
    docs = read(spark, folder, "documents")
    repair.write_ids(docs, str(tmp_path / "ids"), shard_ids=20_000)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    shards = spark.read.parquet(str(tmp_path / "ids")).collect()
    assert len(shards) > 3
    for row in shards[:6]:
        shard = repair.Shard(row.asDict())
        for k in range(0, len(shard.doc_ids), 3):
            wanted = library.encode(texts[int(shard.doc_ids[k])], add_special_tokens=False).ids + [0]
            assert shard.document(k).tolist() == wanted
    assert repair.read_ids(spark, str(tmp_path / "ids")).count() == len(texts)


def check_fingerprints(rows, found):
    ordered = in_order(rows)
    by_text = {}
    left = defaultdict(list)
    for r in found:
        left[r.doc_id].append(r)
    prints = {}
    for r, (_, text, *_) in zip([left[o[0]].pop(0) if len(left[o[0]]) == 1 else None for o in ordered], ordered):
        if r is not None:
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
            prints[text] = int(r.fingerprint, 16)
    edited = Counter()
    for k, (doc_id, text, *_) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert edited == Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found)
    return prints


def test_simhash_edges(edge_docs):
    found = simhash.fingerprint_documents(edge_docs).collect()
    check_fingerprints(edge_rows(edge_docs), found)
    empty = next(r for r in found if r.doc_id == 4)
    assert int(empty.fingerprint, 16) == 0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_simhash_query(spark, folder):
    docs = read(spark, folder, "documents")
    found = catalog.QUERIES["op2_simhash"](spark, folder).collect()
    check_fingerprints([(r.doc_id, r.text or "") for r in docs.collect()], found)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in found}
    ordered = sorted(found, key=lambda r: r.doc_id)
    for r, after in zip(ordered, ordered[1:] + ordered[:1]):
        assert r.near_next == 1 - (prints[r.doc_id] ^ prints[after.doc_id]).bit_count() / simhash.BITS
        near = sum((prints[r.doc_id] ^ p).bit_count() <= simhash.RADIUS for p in prints.values()) - 1
        assert r.near_rows == (near if r.doc_id % 100 == 0 else None)
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.95


def test_block_tables_find_the_whole_radius(spark):
    rng = np.random.default_rng(1)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    prints = list(base)
    for p in base:
        for _ in range(6):
            for bit in rng.choice(simhash.BITS, int(rng.integers(0, 8)), replace=False):
                p ^= 1 << int(bit)
            prints.append(p)
    table = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    found = {r.fingerprint: r.near for r in simhash.within_radius(table, table).collect()}
    for p in prints:
        assert found[f"{p:032x}"] == sum((p ^ q).bit_count() <= simhash.RADIUS for q in prints)


def test_simhash_finds_near_texts(spark):
    rng = np.random.default_rng(3)
    own = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(own))]
    for k in range(1, 21):  # two words of 120: five-word Jaccard of 106 / 126 or more
        changed = list(own)
        for at in rng.choice(120, 2, replace=False):
            changed[at] = f"x{k}"
        rows.append((k, " ".join(changed)))
    rows += [(k, " ".join(f"y{k}z{j}" for j in range(120))) for k in range(21, 40)]
    found = rows_by_id(simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[0][0].near_rows == 20


def test_probes_find_pairs_at_the_radius(spark):
    rng = np.random.default_rng(4)
    base = int.from_bytes(rng.bytes(16), "big")
    prints = [base]
    for n in [simhash.RADIUS] * 60 + [simhash.RADIUS + 1] * 20:
        prints.append(base ^ sum(1 << int(bit) for bit in rng.choice(simhash.BITS, n, replace=False)))
    table = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    (found,) = simhash.within_radius(table.limit(1), table).collect()
    assert (found.fingerprint, found.near) == (f"{base:032x}", 61)


def test_fingerprints_take_texts_in_small_batches_and_leave_few_files(spark, monkeypatch):
    name, n = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions"
    before, seen, tables = (spark.conf.get(name), spark.conf.get(n)), [], []

    def write(df):
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in batches), "b long")
        seen.extend(r.b for r in sizes.collect())
        tables.append(write_once(df))
        return tables[-1]

    rows = spark.range(0, 200, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 8000) as text").coalesce(1)
    monkeypatch.setattr(simhash, "write_once", write)
    spark.conf.set(n, "64")
    try:
        found = simhash.fingerprint_documents(rows)
        assert found.select("doc_id").distinct().count() == found.count() == 200
    finally:
        spark.conf.set(n, before[1])
    assert spark.conf.get(name) == before[0]
    assert max(seen) < 2 * simhash.BATCH_BYTES < sum(seen)
    assert len(tables[0].inputFiles()) <= 8


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, weights = total - sum(fixed.values()), sum(weight[s] for s in open_)
        target = fixed | {s: rest * weight[s] / weights for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(rows):
    sizes, longest = {}, {}
    for r in rows:
        sizes[r.source], longest[r.source] = r.source_size, max(longest.get(r.source, 0), r.size)
    own = Counter()
    taken = Counter()
    for r in rows:
        own[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert own == Counter(sizes) and sum(taken.values()) == sum(sizes.values())
    for r in rows:
        assert r.target == pytest.approx(plain_targets(sizes)[r.source])
    for s in sizes:
        assert abs(taken[s] - rows_target(rows, s)) <= 2 * longest[s] + 1


def rows_target(rows, source):
    return next(r.target for r in rows if r.source == source)


def test_fair_mix_edges(edge_docs):
    found = fairmix.fair_mix(edge_docs).collect()
    check_mix(found)
    words_of = Counter((r[0], len(r[1].split())) for r in edge_rows(edge_docs))
    assert Counter((r.doc_id, r.size) for r in found) == words_of
    assert sorted(map(str, found)) == sorted(map(str, fairmix.fair_mix(edge_docs).collect()))


def test_fair_mix_query(spark, folder):
    check_mix(catalog.QUERIES["op3_fair_mix"](spark, folder).collect())


def test_targets_of_one_large_source(spark):
    sizes = {"a": 1, "b": 10, "c": 100_000, None: 7, "d": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in fairmix.source_targets(df).collect()}
    wanted = plain_targets(sizes)
    assert all(found[s] == pytest.approx(wanted[s]) for s in sizes)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, folder, name):
    assert oracle.compare(catalog.QUERIES[name](spark, folder), oracle.connect(folder), catalog.ORACLE[name]) is None


def test_cover_tree_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1)]
    rows += [(None, [9.0, 9.0], 1), (50, [], 1), (7, [-1.0, -2.0, 3.0], 1), (100, [0.0, 0.0], 1)] + [(k, [0.25, 0.25], 1) for k in range(200, 240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumn("packed", F.lit("x"))
    kept = {(i, tuple(np.floor(256 * np.array(v + [0.0] * (3 - len(v)))).astype(int).tolist())) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q, a in kept:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:5]
            wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    found = covertree.top_products(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_language_edges(edge_docs):
    found = rows_by_id(langid.document_languages(edge_docs))
    assert sum(map(len, found.values())) == edge_docs.count()
    assert found[3][0].accepted and found[3][0].lang == "en"  # the declaration alone
    assert not found[4][0].accepted  # no evidence at all
    assert len({tuple(r) for r in found[6]}) == 2
    kept = langid.accepted_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.accepted for rs in found.values() for r in rs)


def test_language_query_against_declarations(spark, folder):
    found = catalog.QUERIES["op5_language"](spark, folder).collect()
    pages = [r for r in found if r.page_id is not None]
    docs = [r for r in found if r.doc_id is not None]
    assert len(pages) == read(spark, folder, "pages").count() and len(docs) == read(spark, folder, "documents").count()
    for rows in (pages, docs):
        assert np.mean([r.lang == r.declared for r in rows]) > 0.98 and np.mean([r.accepted for r in rows]) > 0.98


def test_language_fusion_against_plain_numbers(spark):
    counts = np.ones((2, 1 << langid.BUCKET_BITS))
    for row, text in ((0, b"the and with "), (1, b"der und mit ")):
        buckets, _ = langid.grams(np.frombuffer(text * 50, np.uint8), np.array([0, len(text) * 50]))
        counts[row] += np.bincount(buckets, minlength=counts.shape[1])
    model = langid.Model(["de", "en"][::-1], counts)
    rows = [("the and", "en", None, "h1", "d"), ("der und", "en", "de", "h1", "d"), ("mit und der", None, None, "h2", "d"), ("", "xx", None, None, None), ("zzz qqq www", None, None, "h3", "e")]
    df = spark.createDataFrame(rows, "text string, declared string, suffix string, host string, domain string").coalesce(1)
    found = langid.fuse(langid.evidence(df.withColumn("n", F.monotonically_increasing_id()), model), model).orderBy("n").collect()
    logs = []
    for text, *_ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        buckets, _ = langid.grams(raw, np.array([0, len(raw)]))
        logs.append(langid.TEXT_WEIGHT * model.logs[:, buckets].sum(axis=1, dtype=np.float64))
    chances = [np.exp(x) / np.exp(x).sum() for x in logs]
    overall = (sum(chances) + 1) / (sum(chances) + 1).sum()
    for k, (text, declared, suffix, host, domain) in enumerate(rows):
        prior = overall
        for column, value in ((4, domain), (3, host)):
            others = [chances[j] for j in range(len(rows)) if j != k and value is not None and rows[j][column] == value]
            prior = (sum(others, np.zeros(3)) + langid.HOST_WEIGHT * prior) / (len(others) + langid.HOST_WEIGHT)
        total = logs[k] + np.log(prior)
        for value, trust in ((declared, langid.DECLARED_TRUST), (suffix, langid.SUFFIX_TRUST)):
            if value in model.languages[:2]:
                total += np.log([trust if x == value else (1 - trust) / 2 for x in model.languages])
        posterior = np.exp(total - total.max())
        posterior /= posterior.sum()
        assert found[k].confidence == pytest.approx(posterior.max()) and found[k].lang == model.languages[int(posterior.argmax())]


def test_page_evidence(spark):
    pages = [
        (1, "https://user@Blog.Example.co.uk:80/a", "<HTML class=x LANG='EN-us'><script>var a='<p>x</p>';</script><p>Hello</p><!-- no --></html>"),
        (2, "not an address", None),
        (3, None, "plain text"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    one, two, three = langid.of_pages(df).orderBy("page_id").collect()
    assert (one.host, one.domain, one.suffix, one.declared, one.text.split()) == ("blog.example.co.uk", "co.uk", "en", "en", ["Hello"])
    assert (two.host, two.text, three.declared, three.text) == (None, None, None, "plain text")


def test_line_dedup_rules(spark, edge_docs):
    rows = [
        (1, "order 17 shipped today in a box\nonly here one two"),
        (2, "order 23 shipped today in a box\nonly there three four"),
        (3, "order x9 shipped today in a bag\nmore words than that"),
        (3, "order x9 shipped today in a bag\nmore words than that"),
        (4, "no no"),
        (5, "no no\norder 17 shipped\n"),
        (None, "order 5 shipped today in a box"),
    ]
    found = rows_by_id(linetree.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[1][0].text == rows[0][1] and found[2][0].text == "only there three four"
    assert [r.text for r in found[3]] == ["more words than that"] * 2  # three of the four places behind the lead agree
    assert found[4][0].text == "no no" and found[5][0].text == rows[5][1]
    assert found[None][0].text == "" and found[None][0].n_dropped == 1
    edges = rows_by_id(linetree.line_dedup(edge_docs, columns=("lang", "body", "label")))
    assert sum(map(len, edges.values())) == edge_docs.count() and edges[1][0].body == "b"
    assert edges[1][0].n_dropped == 0 == edges[2][0].n_dropped  # copies of the keeper
    assert [r.text for r in edges[6] if r.n_lines == 2] == ["same id but another text here"]


def test_line_dedup_leaf_with_two_templates(spark):
    lead = "we saw the"
    rows = [
        (1, f"{lead} one two three four five six seven eight nine ten eleven twelve thirteen"),
        (2, f"{lead} one two three four five six seven eight nine ten eleven twelve thirteen"),
        (2, f"{lead} one two three four five six seven eight nine ten eleven twelve thirteen\nand more of it"),
        (3, f"{lead} red green blue black white brown gray pink gold silver violet orange yellow"),
        (4, f"{lead} red green blue black white brown gray pink gold silver violet orange purple"),
        (5, f"{lead} red green blue black white brown gray pink gold silver violet orange purple here"),
    ]
    found = rows_by_id(linetree.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found[3][0].n_dropped == 0 and found[5][0].n_dropped == 0
    assert found[4][0].n_dropped == 1 and found[4][0].text == ""


def test_line_dedup_keeps_short_lines_that_share_a_lead(spark):
    rows = [(1, "Thor the haan eron."), (2, "Thor the haan for."), (3, "Thor the haan eaesing.\nThor the haan 17"), (4, "Thor the haan 23")]
    found = rows_by_id(linetree.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[k][0].n_dropped for k in (1, 2, 3, 4)] == [0, 0, 0, 1]  # the last differs in a field


def test_line_dedup_judges_what_follows_the_lead(spark):
    """Lines of two and of three places behind the lead must agree in all of them."""
    rows = [(1, "Thor the haan eron quickly."), (2, "Thor the haan eron slowly."), (3, "We like the red car today"), (4, "We like the red car tomorrow"), (5, "We like the blue car today\nWe like the blue car 17")]
    rows += [(6, "We like the blue car 21")]
    found = rows_by_id(linetree.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[k][0].n_dropped for k in range(1, 7)] == [0, 0, 0, 0, 0, 1]


def test_line_dedup_sql_states_several_templates_of_a_leaf(spark):
    rng, words = np.random.default_rng(3), [f"w{chr(97 + k)}" for k in range(6)]
    lines = [["a", "b", "c", *rng.choice(words[:3], int(rng.integers(0, 12))).tolist()] for _ in range(400)]
    rows = [(k, "\n".join(" ".join(x) for x in lines[4 * k : 4 * k + 4])) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert oracle.compare(linetree.line_dedup(docs), con, linetree.SQL) is None


def plain_classes(rows, idf, like=icws.LIKE):
    features, weights = [], []
    for _, raw, offsets in words.slices(pa.array([t for _, t in rows], pa.large_string())):
        terms, counts, begins = icws._shingles(raw, offsets)
        weight = counts * idf[icws._slots(terms)]
        for k in range(len(offsets) - 1):
            features.append(dict(zip(terms[begins[k] : begins[k + 1]].tolist(), weight[begins[k] : begins[k + 1]].tolist())))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = features[a].keys() & features[b].keys()
            low = sum(min(features[a][x], features[b][x]) for x in common)
            all_ = sum(features[a].values()) + sum(features[b].values()) - low
            if rows[a][1] == rows[b][1] or all_ and low / all_ >= like:
                parent[find(a)] = find(b)
    out = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        out[find(k)].append(doc_id)
    return Counter(tuple(sorted(x, key=lambda i: (i is None, i))) for x in out.values())


def found_classes(found):
    out = defaultdict(list)
    for r in found:
        out[r.class_id].append(r.doc_id)
        assert r.class_size >= 1
    return Counter(tuple(sorted(x, key=lambda i: (i is None, i))) for x in out.values())


def test_near_copies_query(spark, folder):
    docs = read(spark, folder, "documents")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    idf = icws.inverse_frequencies(docs)
    assert found_classes(catalog.QUERIES["op7_near_copies"](spark, folder).collect()) == plain_classes(rows, idf)


def test_near_copies_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):  # links form chains, so classes depend on every pair
        own = list(base)
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(0, 120))] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(icws, "BLOCK_TEXTS", 7)
    found = found_classes(icws.near_copies(docs).collect())
    assert found == plain_classes(rows, icws.inverse_frequencies(docs))


def test_near_copies_edges(edge_docs):
    found = rows_by_id(icws.near_copies(edge_docs))
    assert found[1][0].class_id == found[2][0].class_id == 1 and found[1][0].class_size == 2
    assert found[3][0].class_id == found[4][0].class_id == 3
    assert {r.class_size for r in found[6]} == {1, 2} and found[None][0].class_id is None
    kept = icws.representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, 6, 6, None, 7, 8, 9, 10])


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + k, 101 + k) for k in range(15)] + [(200, 300 + k) for k in range(20)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert set(found) == set(near)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for other in near[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert found[node] == min(seen)


def test_running_totals(spark):
    df = spark.range(500).selectExpr("id % 7 AS g", "id AS k", "id % 5 AS v")
    found = [r for r in running_totals(df, ["g", "k"], {"upto": "v"}).collect()]
    total = 0
    for r in sorted(found, key=lambda r: (r.g, r.k)):
        total += r.v
        assert r.upto == total


def test_toxicity_edges(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, None, "x"), (None, 1, "x"), (8, 0, "x"), (9, 1, "x"), (9, 0, "x")], "doc_id long, toxic int, text string")
    found = rows_by_id(toxicity.toxicity_scores(edge_docs, labels))
    assert sum(map(len, found.values())) == edge_docs.count()
    for doc_id, rows in found.items():
        for r in rows:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
            assert r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
    assert found[3][0].score == found[4][0].score == found[5][0].score
    none = toxicity.toxicity_scores(edge_docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in read(spark, folder, "labels").collect()}
    found = [r for r in catalog.QUERIES["op8_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in truth]
    labels, scores = np.array([truth[r.doc_id] for r in found]), np.array([r.score for r in found])
    above = (scores[labels == 1][:, None] > scores[labels == 0][None]).mean()
    assert above > 0.9 and ((scores >= 0.5) == labels).mean() > 0.92


def test_pieces_edges(edge_docs):
    rows = edge_rows(edge_docs)
    wanted = Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.decoded_sha256) for r in pieces.token_digest(edge_docs).collect()) == wanted
    found = pieces.checked_ids(edge_docs).collect()
    assert len(found) == len(rows) and all(r.exact and r.n_ids == len(r.ids) for r in found)


def test_pieces_query(spark, folder):
    wanted = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in read(spark, folder, "documents").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in catalog.QUERIES["op9_sentencepiece"](spark, folder).collect()} == wanted


def test_licenses_edges_and_spans(edge_docs):
    (found,) = licenses.license_spans(edge_docs).collect()
    assert (found.doc_id, found.license, found.coverage, found.span_start, found.span_end) == (8, "mit-notice", 1.0, 0, 30)


def test_licenses_query(spark, folder):
    texts = {r.doc_id: (r.text or "").lower() for r in read(spark, folder, "documents").collect()}
    found = catalog.QUERIES["op10_licenses"](spark, folder).collect()
    for r in found:
        if r.coverage == 1.0 and r.license == "mit-notice":
            assert texts[r.doc_id][r.span_start : r.span_end] == "released under the mit license"
    for name in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice"):
        notice = licenses.TEMPLATES[name].lower().rstrip(".")
        assert {i for i, t in texts.items() if notice in t} <= {r.doc_id for r in found if r.license == name}


def test_mixed_rows(edge_docs):
    found = fairmix.fair_mix(edge_docs).collect()
    wanted = Counter()
    for r in found:
        wanted[r.doc_id] += -(-r.taken // r.size) if r.size else 0
    mixed = fairmix.mixed_rows(edge_docs)
    assert mixed.columns == edge_docs.columns and Counter(r.doc_id for r in mixed.collect()) == +wanted


def test_pipeline(spark, folder):
    docs, seen = read(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = stage(spark, docs, folder).persist()
        assert docs.count() > 0
    for name in ("language", "line_dedup", "near_copies", "mix"):
        assert seen[name].columns == corpus_pipeline.COLUMNS
    rows = [(r.doc_id, r.text) for r in seen["line_dedup"].collect()]
    kept = Counter(r.doc_id for r in seen["near_copies"].collect())
    classes = plain_classes(rows, icws.inverse_frequencies(seen["line_dedup"]))
    assert kept == Counter(min(c) for c in classes)
    mixed = Counter(r.doc_id for r in seen["mix"].collect())
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 3
    last = seen["sentencepiece"].collect()
    assert all(r.exact for r in last) and Counter(r.doc_id for r in last) == mixed
    for df in seen.values():
        df.unpersist()
