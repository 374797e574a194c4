"""The training-data operators against brute force, on small tables with the awkward cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import public_tokenizers
from holdfast.llm import decontaminate, exact_dedup, lm_score, packing, quality, sharding, simhash, suffix_dedup, token_files, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
TEXTS = [
    (1, "The cat sat on the mat.\nThe end."), (2, "the cat  sat on the mat. the end."), (3, None), (4, ""), (5, "   \n"), (None, "no name here"),
    (7, PHRASE * 6 + "first tail"), (8, "own start " + PHRASE * 6 + "second tail"), (9, "aaaa" * 300), (10, "x"), (10, "x"), (12, "é ünïcode 漢字\x1c text  with   spaces"),
    (13, PHRASE * 6 + "first tai1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, row_key long, digest string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def encoded(text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [end]


def test_exact_dedup_and_collisions(spark, docs, empty):
    def squeeze(t):
        return "".join(c for c in t or "" if c not in " \t\n\v\f\r")

    groups = {}
    for i, t in TEXTS:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i is None, i or 0, i))
    expected = Counter((i, min(groups[squeeze(t)])[3], len(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in TEXTS)
    for digest in (exact_dedup.sha256, lambda c: exact_dedup.F.lit("same")):
        found = exact_dedup.exact_dedup(spark, docs, digest=digest).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
        assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: exact_dedup.F.lit("same")], ids=["sha256", "colliding"])
def test_exact_dedup_goes_on_from_its_state(spark, tmp_path, digest):
    schema = "doc_id long, text string"
    first, second = str(tmp_path / "a"), str(tmp_path / "b b")
    spark.createDataFrame([(1, "one  text"), (2, "one text")], schema).coalesce(1).write.parquet(first)
    spark.createDataFrame([(3, "one text"), (4, "other"), (5, "third"), (6, "third")], schema).coalesce(1).write.parquet(second)
    state = str(tmp_path / "state")
    old = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(spark, first, digest=digest, state_dir=state).collect()}
    new = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(spark, second, digest=digest, state_dir=state).collect()}
    assert old == {1: (1, True), 2: (1, False)}
    assert new == {3: (1, False), 4: (4, True), 5: (5, True), 6: (5, False)}


def test_fit_sample_has_whole_texts_within_its_bounds(spark):
    docs = spark.createDataFrame([(i, chr(97 + i) * (40 if i % 2 else 900)) for i in range(20)] + [(3, "again"), (3, "again"), (21, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (5, None), (21, 1)], "doc_id long, toxic int")
    whole = sorted((r.text, r.label) for r in toxicity.training_rows(docs, labels, "toxic", 5, 0, 100, 1 << 20))
    texts = [(i, chr(97 + i) * (40 if i % 2 else 900)) for i in range(20)] + [(3, "again"), (3, "again"), (21, "")]
    assert whole == sorted((t, 1 if i == 21 else i % 2) for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 0)
    some = toxicity.training_rows(docs, labels, "toxic", 5, 0, 100, 2000)
    assert sum(len(r.text) for r in some) <= 2000 and {(r.text, r.label) for r in some} < set(whole)
    assert len(toxicity.training_rows(docs, labels, "toxic", 5, 0, 3, 1 << 20)) == 3
    assert toxicity.training_rows(docs.limit(0), labels, "toxic", 5, 0, 3, 1 << 20) == []


def test_lm_base_and_likelihood(docs, empty):
    found = lm_score.score_texts(docs, passes=2, own=20, hashed=16, hot=10, states=3).collect()
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1 for i, _ in TEXTS}
    words = [(t or "").encode().lower().split() + [b""] for _, t in TEXTS]
    c = Counter(w for (i, _), ws in zip(TEXTS, words, strict=True) if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((held[i], len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws in zip(TEXTS, words, strict=True))
    assert sorted((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {n} and all(r.score < 0 for r in found)
    assert lm_score.score_texts(empty, passes=1).count() == 0


def test_forward_is_exact():
    from itertools import product

    rng = np.random.default_rng(0)
    p = lm_score.Parameters(rng.dirichlet(np.ones(3), 2), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T)
    obs = [np.array([0, 1, 2, 3]), np.array([2])]
    for o, got in zip(obs, lm_score.forward_scores(obs, p), strict=True):
        total = sum(np.prod([p.start[0][s[0]] * p.emit[o[0], s[0]], *(p.move[a, b] * p.emit[x, b] for a, b, x in zip(s, s[1:], o[1:], strict=False))]) for s in product(range(3), repeat=len(o)))
        assert abs(got - math.log10(total)) < 1e-9


def test_token_files_round_trip(docs, empty, tmp_path):
    index = token_files.write_token_files(docs, f"file://{tmp_path}/a", TOKENIZER, shard_bytes=1500)
    found = sorted(token_files.read_token_files(index, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert sorted((r.doc_id or -1, tuple(np.frombuffer(r.ids, "<u4"))) for r in found) == sorted((i or -1, tuple(encoded(t, 0))) for i, t in TEXTS)
    assert [r.doc_id for r in found] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])[:-1]]).tolist()
    none = token_files.write_token_files(empty, f"file://{tmp_path}/b", TOKENIZER)
    assert token_files.read_token_files(none, f"file://{tmp_path}/b").count() == 0


def test_elias_fano_select():
    values = np.cumsum(np.random.default_rng(1).integers(1, 3000, 2000))
    ef = token_files.EliasFano.build(values)
    assert ef.select_run(0, 1999).tolist() == values.tolist()
    for first in (0, 1, 255, 256, 1000, 1999):
        for last in (first, min(first + 1, 1999), min(first + 256, 1999), 1999):
            assert ef.select_run(first, last).tolist() == values[first : last + 1].tolist()
    assert [ef.select(i) for i in (0, 1, 255, 256, 257, 1999)] == values[[0, 1, 255, 256, 257, 1999]].tolist()


def test_encoder_gives_the_librarys_ids():
    from holdfast.llm.shared import UnitEncoder

    odd = [None, "", " a", "a\n\nb", "it's don't, x' y's", "<|endoftext|> a", "a\nb. c!? d's", "Straße ñandú\nÉté… ªº", "日本 語", "x́y z", "a, b. c <b> !? !?\n!? a'b", "x\n- y", "--", "\n", "a\tb", "9 a9 a.9", "ǅ ȸ ɐ Ω"]
    texts = [*odd, *(t for _, t in TEXTS)]
    enc = UnitEncoder(TOKENIZER, most=20, chunk=50)
    for _ in range(2):
        assert enc.direct and [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [encoded(t, 0)[:-1] for t in texts]


def test_packing_covers_every_id_once(docs, empty):
    pieces = packing.pack(docs, TOKENIZER, capacity=64, grain=8).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:], strict=False)) and s[-1].offset + s[-1].length <= 64
    assert sum(p.length for p in pieces) == sum(len(encoded(t, 1)) for _, t in TEXTS)
    seven = sorted((p for p in pieces if p.doc_id == 7), key=lambda p: p.start)
    assert [i for p in seven for i in np.frombuffer(p.ids, "<u4")] == encoded(dict(TEXTS)[7], 1)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_sharding_moves_only_to_the_new_shard(docs, empty):
    keys = sharding.mix(np.arange(20_000).astype(np.uint64))
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert set(b[a != b]) == {8} and 0.09 < (a != b).mean() < 0.13 and np.bincount(a).min() > 2200
    found = sharding.assign_shards(docs).collect()
    assert len(found) == len(TEXTS)
    for k in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))
    assert sharding.assign_shards(empty).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"run_bytes": 3000, "range_bytes": 500}])
def test_suffix_dedup_matches_a_window_count(docs, empty, sizes):
    length, span = 60, 16
    data = [(t or "").encode() for _, t in TEXTS]
    seen = Counter(t[p : p + length] for t in data for p in range(len(t) - length + 1))
    expected = Counter()
    for (i, _), t in zip(TEXTS, data, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        expected[i, len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g)] += 1
    found = suffix_dedup.remove_repeats(docs, length=length, span=span, **sizes).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in found) == expected
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_simhash_components(docs, empty):
    def slow(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [slow(t) for _, t in TEXTS]
    root = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    names = {r: min((i for (i, _), q in zip(TEXTS, root, strict=True) if q == r and i is not None), default=None) for r in set(root)}
    expected = Counter((i, p, names[r]) for (i, _), p, r in zip(TEXTS, prints, root, strict=True))
    found = simhash.near_groups(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == expected
    assert simhash.near_groups(empty).count() == 0


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    x = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(20)]))
    index = simhash.GrayIndex(x)
    q, at = index.search(index.items, np.full(len(x), -1), 4)
    assert len(q) == int((np.bitwise_count(x[:, None] ^ x[None, :]) <= 4).sum())


def _roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_groups_by_similarity_match_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(800)]
    texts = [None, "", " ", "one", "one two three"]
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(20, 200))))
        for edits in (0, 0, 1, 2, 4, 6):
            other = list(base)
            for at in rng.integers(0, len(base), edits):
                other[at] = str(rng.choice(words))
            texts.append(" ".join(other))
        texts += [" ".join(base[: len(base) * 5 // 6]), " ".join(base * 3 + list(rng.choice(words, 30)))]
    line = " ".join(rng.choice(words, 12))
    texts += ["\n".join([line] * 60) + " " + " ".join(rng.choice(words, 40)) for _ in range(3)]  # alike only with repeats counted
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    prints = [simhash.majority(simhash.shingle_set(t, 5)) if x else 0 for t, x in zip(texts, sets, strict=True)]
    same = lambda a, b: sets[a] == sets[b] or (prints[a] ^ prints[b]).bit_count() <= 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = _roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if same(a, b)])
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row_key long, doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_groups(docs, size=5, max_diff=10, similarity=0.8, row_col="row_key").collect()}
    assert found == dict(enumerate(root))
    assert 20 < len(set(root)) < len(texts) - 20
    assert simhash.near_groups(docs.limit(0), size=5, max_diff=10, similarity=0.8, row_col="row_key").count() == 0


def test_every_near_copy_is_found_beyond_the_bits(spark, monkeypatch):
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    line = " ".join(rng.choice(words, 30))
    texts = [None, "", "one two", line]
    for i in range(120):  # few edits each: 0.75 to 0.95 of the shingles in common
        base = list(rng.choice(words, int(rng.integers(80, 200))))
        other = list(base)
        for at in rng.choice(len(base), max(1, len(base) // int(rng.integers(40, 120))), replace=False):
            other[at] = str(rng.choice(words))
        texts += [" ".join(base) + " " + line * (i % 3 == 0), " ".join(other) + " " + line * (i % 3 == 0), " ".join(base[: len(base) * 41 // 50])]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    prints = [simhash.majority(simhash.shingle_set(t, 5)) if x else 0 for t, x in zip(texts, sets, strict=True)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    within = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 12]
    expected = _roots(len(texts), pairs)
    assert _roots(len(texts), within) != expected  # some pairs are beyond the index
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row_key long, doc_id long, text string")
    for sample in (1, 16):  # the order of the shingles has no say in the result
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        found = {r.doc_id: r.component_id for r in simhash.near_groups(docs, size=5, max_diff=12, similarity=0.8, row_col="row_key", every=True).collect()}
        assert found == dict(enumerate(expected))


def test_index_links_across_blocks_match_brute_force(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    for _ in range(3):
        x = np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)), x ^ (np.uint64(5) << rng.integers(0, 60, len(x)).astype(np.uint64))])
    group = rng.integers(0, 5, len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    rows = spark.createDataFrame([(i, int(f.view(np.int64)), int(g)) for i, (f, g) in enumerate(zip(x, group, strict=True))], "node long, fp long, group long")
    expected = {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True) if group[a] != group[b]}
    for block in (8, 8192):
        found = [(min(r.u, r.v), max(r.u, r.v)) for r in simhash.link(rows, 4, block=block, cross=True).collect()]
        assert len(found) == len(expected) and set(found) == expected
        tree = [(r.u, r.v) for r in simhash.link(rows.drop("group"), 4, block=block).collect()]
        assert _roots(len(x), tree) == _roots(len(x), list(zip(*np.nonzero(near), strict=True)))


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PHRASE + "and the answer is forty two"), (2, None), (3, "..."), (4, "nothing like any of these words is anywhere at all in here")], "item_id long, text string")
    texts = [(1, "before it " + PHRASE + "and the answer is forty two after it"), (2, "before it " + PHRASE.replace("gamma", "gam").replace("nu", "new") + "and the answer is forty two"), (3, "quite different prose of its own kind " * 20), (None, None)]
    found = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1)]
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_decontamination_finds_what_a_full_scan_finds(spark):
    rng = np.random.default_rng(14)
    words = ["".join(rng.choice(list("abcdefghijklm"), 4)) for _ in range(4000)]
    pick = lambda n: [str(w) for w in rng.zipf(1.3, n).clip(1, 4000) - 1]
    prose = lambda n: [words[int(i)] for i in pick(n)]
    items = [prose(int(rng.integers(15, 140))) for _ in range(150)]
    texts = []
    for n in range(60):
        item = list(items[n])
        if n % 2:  # a paraphrase: a third of the words before it are others, the answer stays
            for at in rng.choice(len(item) - 8, (len(item) - 8) // 3, replace=False):
                item[at] = str(rng.choice(words))
        texts.append(prose(int(rng.integers(0, 90))) + item + prose(int(rng.integers(0, 90))))
    table = spark.createDataFrame([(i, " ".join(x[:-8]) + ". " + " ".join(x[-8:])) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    index = decontaminate.build_index(table)
    plain = [decontaminate.plain_words(" ".join(x)) for x in texts]
    expected = set()
    for n in range(len(index.words)):
        widths = [w * decontaminate.UNIT for (whose, _), w in zip(index.scales, decontaminate.SCALES, strict=True) if n in whose]
        for t, x in enumerate(plain):
            if len(set(x) & index.sets[n]) >= max(1, index.need[n]):
                last = -(-len(x) // decontaminate.UNIT) * decontaminate.UNIT
                if any(index.judge(n, x, b, min(b + w, last)) for w in widths for b in range(0, len(x), w // 2)):
                    expected.add((t, index.ids[n]))
    rows = decontaminate.matches(docs, table).collect()
    found = [(r.doc_id, r.item_id) for r in rows]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) >= 50
    assert min(r.cosine for r in rows) < decontaminate.NEAR  # some are no latent candidates


def test_common_subsequence():
    assert decontaminate.common_subsequence(b"a b c d e".split(), b"a x c y e a b".split()) == 3


def test_toxicity_ranks_held_out_texts_and_shares_subwords():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeghlnorstu"), 5)) for _ in range(2000)]
    plain = [" ".join(rng.choice(words, 40)) for _ in range(900)]
    bad = [" ".join([*rng.choice(words, 30), "wxyzzyfoul", *rng.choice(words, 10)]) for _ in range(300)]
    model = toxicity.Model(*toxicity.fit(plain[:800] + bad[:250], [0] * 800 + [1] * 250))
    clean, toxic = [model.score(t) for t in plain[800:]], [model.score(t) for t in bad[250:]]
    # Ranking only: on a fixture this small the fit is over-sure, and 0.893 of the texts fall on the
    # right side of 0.5.  Accuracy is tested on the labelled table below.
    assert np.mean([c < t for c in clean for t in toxic]) >= 0.98
    assert model.score(plain[0] + " wxyzzyfoull") > 10 * model.score(plain[0])
    assert model.score(None) == model.score(" \n") < 0.5 and toxicity.fit([], [])[1] < -30


def test_toxicity_reads_long_words_whole():
    word = "".join(np.random.default_rng(8).choice(list("abcdeghlnorstué漢"), 400))
    body = f"<{word}>"
    expected = {zlib.crc32(body[i : i + n].encode()) % toxicity.BUCKETS for n in (3, 4, 5, 6) for i in range(len(body) - n + 1)}
    parts = toxicity.passage_words(word)
    assert {g for p in parts for g in toxicity.grams(p)} == expected == set(toxicity.grams(word.encode()))
    assert max(map(len, parts)) <= 1 + 3 * toxicity.PIECE and toxicity.passage_words("x" * 24) == [b"x" * 24]
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeghlnorstu"), 5)) for _ in range(2000)]
    plain = [list(rng.choice(words, 40)) for _ in range(900)]
    texts = [" ".join(t) for t in plain] + [" ".join([*t[:30], "wxyzzyfoul", *t[30:]]) for t in plain[:250]]
    model = toxicity.Model(*toxicity.fit(texts, [0] * 900 + [1] * 250))
    for joint in ("-", "_", ",", "/", "\u00a0", "\u3000"):
        pairs = [(model.score(joint.join(t)), model.score(joint.join([*t[:20], "wxyzzyfoul", *t[20:]]))) for t in plain[800:]]
        assert np.mean([foul > clean for clean, foul in pairs]) >= 0.9


def test_toxicity_accuracy_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.op2(spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert len(found) > 500
    # About a third of the toxic labels of this table are on texts without any toxic word (30 of 97
    # when written), so recall against the labels can't be near 1; measured: 0.67, false alarms 0.001.
    assert np.mean([r.predicted == r.toxic for r in found]) >= 0.95
    assert np.mean([r.predicted for r in found if not r.toxic]) <= 0.02


def test_quality_labels_lines():
    rng = np.random.default_rng(6)
    line = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(8)).capitalize() + "."
    good = ["\n".join(line() for _ in range(5)) for _ in range(100)]
    junk = ["\n".join(line().upper() + "!! $$$" for _ in range(5)) for _ in range(100)]
    model = quality.fit(good[:80] + junk[:80], [1] * 80 + [0] * 80)
    assert (quality.text_scores(good[80:], model) >= 0.7).all() and (quality.text_scores(junk[80:], model) < 0.3).all()
    assert quality.text_scores([None, "", "\n \n"], model).tolist() == [0.5] * 3


def test_chain_marginals_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(7)
    unary, move = rng.standard_normal((4, 2)), rng.standard_normal((2, 2))
    weight = {y: math.exp(sum(unary[i, v] for i, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=4)}
    marginals, _, log_z = quality.Chains(np.zeros(4, dtype=np.int64)).run(unary, move)
    z = sum(weight.values())
    assert abs(log_z - math.log(z)) < 1e-9
    assert np.allclose(marginals[:, 1], [sum(w for y, w in weight.items() if y[i]) / z for i in range(4)])


def test_word_masks_count_the_distinct_words_in_common():
    words = ["alpha", "beta", "gamma", "delta", "beta"]
    row_of = {w.encode(): i for i, w in enumerate(sorted(set(words)))}
    index = decontaminate.Index([(1, " ".join(words))], np.eye(4), row_of, np.ones(4))
    rows = np.array([row_of.get(w, -1) for w in (b"beta", b"zeta", b"beta", b"alpha", b"eta")])
    assert (index.mask(rows) & index.masks[0]).bit_count() == 2
    assert index.mask(np.array([-1, -1])) == 0


def test_sketches_never_differ_in_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 150, 3000):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for changed in {0, min(1, size), size // 10, size}:
            other = np.concatenate([base[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)])
            x, y = (np.frombuffer(simhash.sketch(np.unique(s)), dtype=np.uint64) for s in (base, other))
            assert np.bitwise_count(x ^ y).sum() <= len(set(base.tolist()) ^ set(other.tolist()))


def test_copies_of_fingerprints_under_masks_stay_bounded():
    for count in (1_000, 250_000, 2_500_000, 1 << 40):
        for most in (4, 12):
            chosen = simhash.masks(count, most)
            assert len(chosen) <= simhash.TABLES
            assert all(sum(m >> b & 1 for m in chosen) for b in range(64))


def test_large_group_of_near_copies_gives_few_pairs_and_loses_no_link(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 146).astype(np.uint64)
    sets = []
    for changed in [*range(2, 26)] * 10:
        own = base.copy()
        own[rng.choice(len(base), changed, replace=False)] = rng.integers(0, 1 << 63, changed).astype(np.uint64)
        sets.append(np.unique(own))
    none = np.zeros(0, dtype=np.uint64)
    rows = [(i, i, len(s), simhash.lead(s, none, 0.8).view(np.int64).tolist(), bytearray(simhash.sketch(s))) for i, s in enumerate(sets)]
    placed = spark.createDataFrame(rows, "node long, group long, n int, lead array<long>, sketch binary")
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)}
    members = simhash.shared_leads(placed)
    assert members.count() <= sum(len(r[3]) for r in rows)
    forest = {(r.u, r.v) for r in simhash.set_links(members, placed, 0.8, spanning=True).collect()}
    assert near and len(forest) < members.count()
    assert near <= {(r.u, r.v) for r in simhash.set_links(members, placed, 0.8).collect()}


def test_large_unlike_sets_are_ruled_out_before_whole_sets_are_sent(spark):
    rng = np.random.default_rng(21)
    sets = []
    for size in (1, 500, 1500, 4000, 9000):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)])) for changed in (0, size // 20, size // 9, size // 2, size)]
        sets.append(np.unique(base[: size * 41 // 50]))
    sets.append(np.zeros(0, dtype=np.uint64))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    for i, j in pairs:
        assert simhash.differing(simhash.wide_sketch(sets[i]), simhash.wide_sketch(sets[j])) <= len(np.setxor1d(sets[i], sets[j]))
    share = {(i, j): len(np.intersect1d(sets[i], sets[j])) / max(1, len(np.union1d(sets[i], sets[j]))) for i, j in pairs}
    wides = spark.createDataFrame([(i, len(s), bytearray(simhash.wide_sketch(s))) for i, s in enumerate(sets)], "node long, n int, wide binary")
    left = {(r.u, r.v) for r in simhash.sift(spark.createDataFrame(pairs, "u long, v long"), wides, 0.8).collect()}
    assert {p for p in pairs if share[p] >= 0.8} <= left
    assert not {p for p in left if share[p] < 0.5 and max(len(sets[k]) for k in p) > 1}
