"""The vectorised kernels against plain Python."""

import random
import string
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from ledgerlens.llm import bytebpe, covertree, icws, licenses, pieces, repair, toxicity, words

TEXTS = ["", None, " a  b ", "One two\nTHREE", "é ß\tx", "x" * 3000, "日本 😀", "a b c d e f g", "a b c d e f g"]


def lower(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def test_word_hashes_follow_the_words():
    seen = {}
    for limit in (8, 1 << 20):
        for first, raw, offsets in words.slices(pa.array(TEXTS), limit):
            starts, ends, firsts = words.bounds(raw, offsets)
            hashed = words.word_hashes(raw, starts, ends)
            for k in range(len(offsets) - 1):
                own = [lower(w) for w in (TEXTS[first + k] or "").split()]
                assert len(own) == firsts[k + 1] - firsts[k]
                for w, h in zip(own, hashed[firsts[k] : firsts[k + 1]].tolist()):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_and_bags():
    hashed = np.array([5, 6, 5, 6, 5, 9], np.uint64)
    runs, begins = words.shingles(hashed, np.array([0, 5, 5, 6]), 2)
    assert begins.tolist() == [0, 4, 4, 5] and runs[0] == runs[2] and runs[1] == runs[3] and len(set(runs.tolist())) == 3
    values, counts, at = words.bags(runs, begins)
    assert counts.tolist() == [2, 2, 1] and at.tolist() == [0, 2, 2, 3]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.model_path())


def plain_viterbi(text, scores, worst):
    if not text:
        return []
    s = "▁" + text.replace("▁", "\U0010ffff").replace(" ", "▁")
    best, step = [0.0] + [None] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for n in range(min(16, end), 0, -1):
            found = scores.get(s[end - n : end])
            score, piece = found if found else (worst, -1)
            if (found or n == 1) and (best[end] is None or best[end - n] + score > best[end]):
                best[end], step[end] = best[end - n] + score, (n, piece)
    out, end = [], len(s)
    while end:
        n, piece = step[end]
        char = "▁" if s[end - 1] == "\U0010ffff" else s[end - 1]
        out += [piece] if piece >= 0 else [3 + b for b in reversed(char.encode())]
        end -= n
    return out[::-1]


def test_pieces_equal_plain_viterbi_and_round_trip(model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    scores = {
        library.id_to_piece(k): (library.get_score(k), k)
        for k in range(library.vocab_size())
        if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k))
    }
    rng = random.Random(1)
    made = ["".join(rng.choice("thein oan▁\n é日\t") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts = [t or "" for t in TEXTS] + made + ["</s> <0x0A>", "thing " * 40]
    for first, raw, offsets in words.slices(pa.array(texts), 500):
        ids, at = model.encode(raw, offsets)
        back, back_at = model.decode(ids, at)
        for k in range(len(offsets) - 1):
            text = texts[first + k]
            assert ids[at[k] : at[k + 1]].tolist() == plain_viterbi(text, scores, model.worst), text
            assert back[back_at[k] : back_at[k + 1]].tobytes().decode() == text


def test_byte_bpe_equals_the_library():
    encoder = bytebpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    made = ["".join(rng.choice("ab'sdtrevml  \n\t1²é_-.!\xa0\x85\x1cß") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts = [t or "" for t in TEXTS] + made + ["it's we're  'll x", "a<|endoftext|>b", "日本 's", "x'", "''s", " \n's \n", "'something"]
    for first, raw, offsets in words.slices(pa.array(texts), 3000):
        ids, at = encoder.encode(raw, offsets)
        wanted = encoder.library.encode_batch(texts[first : first + len(offsets) - 1], add_special_tokens=False)
        for k, w in enumerate(wanted):
            assert ids[at[k] : at[k + 1]].tolist() == w.ids, texts[first + k]


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 400, 3000):
        for k in (1, 2, 9):
            ids = rng.integers(0, k, n)
            body, rules, lengths = repair.compress(ids, 50, least=2, pairs=5)
            assert repair.expand(body, 50, rules).tolist() == ids.tolist()
            row = {"base": 50, "doc_ids": b"", "doc_starts": b"", "rules": rules.astype("<u4").tobytes()}
            row |= {"lengths": lengths.astype("<u4").tobytes(), "body": body.astype("<u4").tobytes()}
            shard = repair.Shard(row)
            assert not n or len(body) < n or n < 5 or k > 2
            for _ in range(10):
                a, b = sorted(rng.integers(0, n + 1, 2).tolist())
                assert shard.ids(a, b).tolist() == ids[a:b].tolist()


def test_cover_trees_cover_and_search_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(12):
        d, n, m = int(rng.integers(1, 6)), int(rng.integers(1, 700)), int(rng.integers(1, 150))
        centers = rng.integers(-60, 60, (int(rng.integers(1, 9)), d))
        data = (centers[rng.integers(0, len(centers), n)] + rng.integers(-3, 4, (n, d))).astype(np.int64)
        asked = (centers[rng.integers(0, len(centers), m)] + rng.integers(-2, 3, (m, d))).astype(np.int64)
        tree = covertree.CoverTree(data)
        for node in range(len(tree.centers)):
            own = tree.space[tree.lo[node] : tree.hi[node]]
            assert np.sqrt(((own - tree.middle[node]) ** 2).sum(axis=1)).max() <= tree.radii[node] + 1e-9
            centre = tree.middle[tree.kids[node]] if tree.kids[node] else own[:0]
            apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(centre))
            assert not len(centre) or apart.min() > tree.radii[node] / covertree.BASE - 1e-6
        data_tree, _ = covertree._unpack(covertree._pack(tree))
        queries = covertree.CoverTree(asked)
        best = covertree.Best(m, 6)
        covertree.dual_search(queries, data_tree, np.arange(n + 1), tree.order, best)
        found = {q: [] for q in range(m)}
        for r, s, i in zip(best.row.tolist(), best.score.tolist(), best.id.tolist()):
            found[int(queries.order[r])].append((-s, i))
        scores = asked @ data.T
        for q in range(m):
            assert found[q] == sorted((-int(s), i) for i, s in enumerate(scores[q]))[:6]


def test_weighted_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(4)
    base = words.mix(rng.integers(1, 1 << 60, 400).astype(np.uint64))
    weights = rng.uniform(1, 4, 400).astype(np.float32)
    other, other_weights = base.copy(), weights.copy()
    other[:60] = words.mix(rng.integers(1, 1 << 60, 60).astype(np.uint64))
    other_weights[100:150] *= 2
    both = icws.Sampler(1500).sketch(np.concatenate([base, other]), np.concatenate([weights, other_weights]), np.array([0, 400]))
    alike = icws.likeness([base, other], [weights, weights])[0, 1]
    common = np.minimum(weights[60:], other_weights[60:]).sum()
    true = common / (weights.sum() + other_weights.sum() - common)
    assert abs((both[0] == both[1]).mean() - true) < 0.05
    unweighted = weights[60:].sum() / (2 * weights.sum() - weights[60:].sum())
    assert abs(alike - unweighted) < 1e-5


def test_forest_spans_the_links():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 4)):
        linked[a, b] = linked[b, a] = True
    assert sorted(map(sorted, icws.forest(linked))) == [[0, 3], [1, 4], [3, 5]]


def plain_align(template, text):
    best, found = (-(1 << 30), 0), {}
    for i, a in enumerate(template):
        for j, b in enumerate(text):
            if a == b:
                options = [(2 - i, 1)]
                options += [(s - (i - x - 1) - (j - y - 1) + 2, m + 1) for (x, y), (s, m) in found.items() if x < i and y < j]
                found[i, j] = max(options, key=lambda o: o[0])
                total = found[i, j][0] - (len(template) - 1 - i)
                best = max(best, (total, found[i, j][1]), key=lambda o: o[0])
    return best[0]


def test_alignment_reaches_the_best_score():
    rng = random.Random(5)
    for _ in range(150):
        template = [rng.randint(0, 20) for _ in range(rng.randint(1, 10))]
        text = list(template)
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randint(0, len(text)), rng.randint(0, 20))
        matched, first, last = licenses.align(np.array(template, np.uint64), np.array([50, *text, 51], np.uint64), 1, 20)
        left_out_template, left_out_text = len(template) - matched, last - first + 1 - matched
        assert 2 * matched - left_out_template - left_out_text == plain_align(template, [50, *text, 51])


def test_license_index_finds_what_a_full_scan_finds():
    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(6)
    fill = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(200)]
    texts, wanted = [], []
    for name, template in sorted(licenses.TEMPLATES.items()):
        own = template.split()
        if len(own) > 20:
            own[len(own) // 2] = "changed"
        texts.append(" ".join([*rng.sample(fill, 30), *own, *rng.sample(fill, 30)]))
        wanted.append(name)
    texts.append(" ".join(fill))
    found = {k: set() for k in range(len(texts))}
    for first, raw, offsets in words.slices(pa.array(texts), 2000):
        for k, t, matched, share, a, b in licenses.scan(index, raw, offsets, 0.8):
            found[first + k].add(index.names[t])
            assert share >= 0.8 and 0 <= a < b <= len(raw)
    assert all(name in found[k] for k, name in enumerate(wanted)) and not found[len(texts) - 1]


def test_license_relatives_are_told_apart():
    grant = licenses.TEMPLATES["gpl-3.0"]
    sentence = licenses.TEMPLATES["cc-by"]
    wanted = {
        "Licensed under CC BY-ND 4.0.": "cc-by-nd-notice",
        "Licensed under CC BY 4.0.": "cc-by-notice",
        sentence: "cc-by",
        sentence.replace("Attribution", "Attribution-ShareAlike"): "cc-by-sa",
        sentence.replace("Attribution", "Attribution-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-notice",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-notice",
        grant: "gpl-3.0",
        grant.replace("GNU", "GNU Affero"): "agpl-3.0",
        grant.replace("version 3", "version 2"): "gpl-2.0",
    }
    index = licenses.Index(licenses.TEMPLATES)
    texts = [f"some words before it {t} and some words behind it" for t in wanted]
    found = [[] for _ in texts]
    for first, raw, offsets in words.slices(pa.array(texts)):
        for k, t, *_ in licenses.scan(index, raw, offsets, licenses.COVERAGE):
            found[first + k].append(index.names[t])
    assert found == [[name] for name in wanted.values()]


def test_toxicity_learns_misspellings():
    rng = random.Random(7)
    clean = ["".join(rng.choice(["an", "er", "th", "on", "in", "re"]) for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for k in range(400):
        own = [rng.choice(clean) for _ in range(40)]
        if k % 2:
            own[rng.randrange(40)] = rng.choice(["worthless", "pathetic", "disgusting"])
            own[rng.randrange(40)] = rng.choice(["worthless", "pathetic", "disgusting"])
        texts.append(" ".join(own))
        labels.append(k % 2)
    bags = [b for _, raw, offsets in words.slices(pa.array(texts)) for b in toxicity.bags(raw, offsets)]
    weights, bias = toxicity.train(bags, np.array(labels))
    test = [" ".join(rng.choice(clean) for _ in range(40)), " ".join(rng.choice(clean) for _ in range(38)) + " worthles patheticc"]
    scores = np.concatenate([toxicity.score(raw, offsets, weights, bias) for _, raw, offsets in words.slices(pa.array(test))])
    assert scores[0] < 0.5 < scores[1]
    assert toxicity.train([], np.array([]))[1] == 0.0


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("Licensed under CC BY-NC-SA 3.0.", []),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-notice"]),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["gpl-3.0-text"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", ["gpl-2.0-text"]),
        ("// SPDX-License-Identifier: MIT\nint x;", ["spdx-mit"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["spdx-gpl-2.0-or-later"]),
        ("SPDX-License-Identifier: GPL-1.0-only", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under the GNU General Public License, version 3.1.", []),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mpl-2.0"]),
    ],
)
def test_license_versions_match_exactly(text, wanted):
    index = licenses.Index(licenses.TEMPLATES)
    ((_, raw, offsets),) = words.slices(pa.array([text], pa.large_string()))
    assert [index.names[t] for _, t, *_ in licenses.scan(index, raw, offsets, licenses.COVERAGE)] == wanted


def test_repeated_notices_take_seconds():
    index = licenses.Index(licenses.TEMPLATES)
    begun = time.perf_counter()
    ((_, raw, offsets),) = words.slices(pa.array(["All rights reserved. " * 100_000], pa.large_string()))
    found = list(licenses.scan(index, raw, offsets, licenses.COVERAGE))
    assert len(found) == 100_000 and found[7][4:6] == (147, 166)
    assert time.perf_counter() - begun < 60


def test_license_spans_apart_equal_comparing_all():
    rng = np.random.default_rng(3)
    found = [(int(t), int(n), 1, 0.9, int(a), int(a + size), int(score)) for t, n, a, size, score in zip(rng.integers(0, 3, 600), rng.integers(0, 4, 600), rng.integers(0, 900, 600), rng.integers(1, 60, 600), rng.integers(0, 30, 600))]
    kept = {}
    for m in sorted(found, key=lambda m: (m[0], -m[6], -m[3], m[1], m[4])):
        own = kept.setdefault(m[0], [])
        if not any(2 * (min(o[5], m[5]) - max(o[4], m[4])) >= min(o[5] - o[4], m[5] - m[4]) for o in own):
            own.append(m)
    wanted = [m[:6] for own in kept.values() for m in sorted(own, key=lambda m: (m[4], m[1]))]
    assert list(licenses._apart(list(found))) == wanted


def test_one_long_unit_equals_the_batched_search():
    known = pieces.load(pieces.model_path())
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("thewordsareglued\u65e5\u672c\U0001f600\u00e9\u2581"), 3 * pieces.LONG // 2))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.where(codes == pieces.SPACE, np.uint32(pieces.LITERAL), codes)
    assert (known.viterbi_long(codes) == known.viterbi(codes[None])[0]).all()
    raw = np.frombuffer(("a " + text + " b\n" + text).encode(), np.uint8)
    ids, begins = known.encode(raw, np.array([0, len(raw)]))
    assert known.decode(ids, begins)[0].tobytes() == raw.tobytes()


def test_a_long_word_keeps_memory_bounded():
    """A word of several stretches: a byte per character and the ids, not the sums of all ends."""
    import tracemalloc

    known = pieces.load(pieces.model_path())
    codes = np.frombuffer(("xxxxxab" * 20_000).encode("utf-32-le"), np.uint32)
    tracemalloc.start()
    ids = known.viterbi_long(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) and peak < 48 << 20


def plain_compress(ids, base, pairs, least):
    """The rounds of ``repair.compress`` over lists, each counting all pairs."""
    body, rules = list(ids), []
    while True:
        often = sorted((-n, key) for key, n in Counter(zip(body, body[1:])).items() if n >= least)[: 4 * pairs]
        left, right, chosen = set(), set(), {}
        for _, (a, b) in often:
            if len(chosen) < pairs and a not in right and b not in left:
                left.add(a)
                right.add(b)
                chosen[a, b] = base + len(rules) + len(chosen)
        if not chosen:
            return body, rules
        rules += chosen
        k, out = 0, []
        while k < len(body):
            pair = tuple(body[k : k + 2])
            out.append(chosen.get(pair, body[k]))
            k += 2 if pair in chosen else 1
        body = out


def test_rounds_equal_counting_all_pairs():
    rng = np.random.default_rng(5)
    for k in range(300):
        ids = rng.integers(0, rng.integers(1, 6), rng.integers(0, 80))
        if k % 3 == 0:
            ids = np.repeat(ids, rng.integers(1, 9, len(ids)))
        pairs, least = int(rng.integers(1, 6)), int(rng.integers(2, 5))
        body, rules, _ = repair.compress(ids, 50, pairs=pairs, least=least)
        assert (body.tolist(), [tuple(x) for x in rules.tolist()]) == plain_compress(ids.tolist(), 50, pairs, least)


def test_rounds_look_only_at_pairs_that_can_be_frequent(monkeypatch):
    rng = np.random.default_rng(6)
    phrase, rare = rng.integers(0, 1000, 64), rng.integers(1000, 50_000, 60_000)
    ids = np.concatenate([np.append(phrase, rare[k : k + 1000]) for k in range(0, len(rare), 1000)])
    seen, plain = [], np.sort
    monkeypatch.setattr(repair.np, "sort", lambda a: seen.append(len(a)) or plain(a))
    body, rules, lengths = repair.compress(ids, 50_000)
    assert len(seen) > 5 and sum(seen) < 1.5 * len(ids) and lengths.max() == 64
    assert (repair.expand(body, 50_000, rules) == ids).all()


def test_words_of_one_slot_are_both_remembered(monkeypatch):
    """Two words whose hashes fall on one slot don't drive each other out."""
    monkeypatch.setattr(bytebpe, "TABLE_BITS", 16)
    encoder = bytebpe.Encoder(pieces.model_path(repair.MODEL))
    rng = np.random.default_rng(8)
    said = "".join(" " + "".join(rng.choice(list("abcdefgh\u00e9"), 9)) for _ in range(4000))
    raw = np.frombuffer(said.encode(), np.uint8)
    wanted = encoder.library.encode(said, add_special_tokens=False).ids
    asked, new_ids = [], encoder._new_ids
    monkeypatch.setattr(encoder, "_new_ids", lambda codes, sizes: asked.append(len(sizes)) or new_ids(codes, sizes))
    for _ in range(2):
        assert encoder.encode(raw, np.array([0, len(raw)]))[0].tolist() == wanted
    assert asked[0] == 4000 and sum(asked[1:]) < 40


def test_joined_words_have_the_ids_of_single_ones():
    encoder = bytebpe.Encoder(pieces.model_path(repair.MODEL))
    spelled = [" word", " \u00e9t\u00e9", "word", " 12", "  ", " a", "don", "'t", " x" * 3, "\n"]
    codes = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
    ids, counts = encoder._new_ids(codes, np.array([len(w) for w in spelled]))
    wanted = [encoder.library.encode(w, add_special_tokens=False).ids for w in spelled]
    assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_joined_letters_have_the_ids_of_the_whole_text():
    encoder = bytebpe.Encoder(pieces.model_path(repair.MODEL))
    letters = "".join(" x" + chr(c) for c in range(bytebpe.KNOWN) if bytebpe._KIND[c] == bytebpe.LETTER)
    assert encoder._joined_ids(np.frombuffer(letters.encode("utf-32-le"), np.uint32)) == encoder.library.encode(letters, add_special_tokens=False).ids
