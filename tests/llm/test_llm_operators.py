"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("marlstone.llm")

from pyspark.sql import functions as F

from marlstone.llm import chat, class_lm, common, decontamination, language, line_dedup, near_dup, packing, quality, queries, rules, token_files
from marlstone.llm.tokens import Encoder

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, label string, class string, spans int, score double, text_a string, key string, nothing void"
LONG = " ".join(f"word{k % 977} other{k % 31}." for k in range(30_000))
PASSAGE = "The river ran past the mill. Nobody had seen the miller since spring came. His boat lay under the old willow tree. Children said that it sang at night."
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 10, "x", None),
    (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 10, "x", None),
    (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 10, "x", None),
    (3, None, None, None, None, None, None),
    (4, "", "de", "a", 0, "y", "l"),
    (None, "no id at all, but some words are here", "de", None, 5, "z", None),
    (5, " \n\t ", "fr", "b", 4, None, None),
    (6, LONG, "en", "b", len(LONG), None, None),
    (7, "start of seven is its own. " + PASSAGE + " The end of seven differs.", "en", "b", 1, None, None),
    (8, "Eight begins in another way. " + PASSAGE + " And it ends unlike the others.", "en", "c", 1, None, None),
    (9, "é ñ ü 123 $$$ |||   İ ﬁ ​", "es", "c", 1, None, None),
]


ROWS = [(*r, "c", 1, 0.5, "a", "k", None) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def real(spark, sf):
    return common.read(spark, sf, "documents")


def key(v):
    return tuple((x is not None, str(x)) for x in v)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items, window=10):
    out = []
    grams = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(g) for g in grams}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


def test_decontamination_is_brute_force(spark, docs, none):
    items = [(1, "two three FOUR five six seven eight nine ten eleven"), (12, "one two three"), (3, None), (4, "!!"), (None, "the old willow tree"), (5, "words are here"), (6, "word5 other5")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for vocabulary_block in (4_000_000, 20):  # one block, and many
        got = decontamination.decontaminate(docs, benchmark, block_bytes=vocabulary_block)
        assert sorted(map(tuple, got.collect()), key=key) == brute_hits([(r[0], r[1]) for r in ROWS], items)
    assert decontamination.decontaminate(none, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 9}


def test_decontamination_on_real_rows(spark, real, sf):
    benchmark = common.read(spark, sf, "benchmark")
    got = sorted(map(tuple, queries.op1_decontamination(spark, sf).collect()), key=key)
    assert got == brute_hits([(r.doc_id, r.text) for r in real.collect()], [(r.item_id, r.text) for r in benchmark.collect()])


def test_proximity_finds_what_exact_search_misses(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "delta gamma beta alpha q q q q q q")], "doc_id bigint, text string")
    item = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id bigint, text string")
    blocks = next(decontamination.query_blocks(rows, item, 4))
    index = decontamination.build_index(rows)
    found = {(r.id, r.start, r.exact) for r in decontamination.proximity(index, blocks, 1).collect()}
    assert (1, 0, True) in found and any(d == 2 and not e for d, _, e in found) and not any(d == 3 for d, *_ in found)
    ends = spark.createDataFrame([(1, "q q alpha beta delta"), (2, "beta gamma delta"), (3, "q q alpha"), (4, "beta gamma delta q")], "doc_id bigint, text string")
    for window, want in ((4, []), (3, [1])):  # a word left out at a document's end; nothing reaches over into the next document
        item = spark.createDataFrame([(7, "alpha beta gamma delta" if window == 4 else "alpha beta x delta")], "item_id bigint, text string")
        blocks = next(decontamination.query_blocks(ends, item if window == 4 else spark.createDataFrame([(7, "alpha beta delta")], "item_id bigint, text string"), window))
        got = {r.id for r in decontamination.proximity(decontamination.build_index(ends), blocks, 1).collect()}
        assert got == set(want)
    near = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c x d e f g h i j"), (3, "j i h g f e d c b a"), (4, "a b c d e f g h i"), (5, None)], "doc_id bigint, text string")
    item = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "c b")], "item_id bigint, text string")
    assert {r.doc_id for r in decontamination.drop_contaminated(near, item.filter("item_id = 1")).collect()} == {2, 3, 4, 5}
    assert {r.doc_id for r in decontamination.drop_contaminated(near, item.filter("item_id = 1"), slop=1).collect()} == {3, 4, 5}
    assert decontamination.drop_contaminated(near.limit(0), item).count() == 0 and decontamination.drop_contaminated(near, item.limit(0)).count() == 5


def test_encoder_gives_the_librarys_ids(real):
    odd = ["", None, "  a  b\n\n c\t\td  \n", "it's 'S ''s l'd'lla don't", "A\r\n B İ ΣΑΣ é ﬁ x", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "a\x1cb\x85c", "ß ÿ Ý × ÷ ª º µ", " \n \n lead Éa!!", "123 45a6 __x__ --''--", " , .x a.'s b.,' c'.", LONG]
    texts = odd + [r.text for r in real.limit(60).collect()]
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder, library = Encoder(queries.vocabulary(name)), Tokenizer.from_file(queries.vocabulary(name))
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want
        assert encoder.encode(texts) == want  # from the cache


def test_packing(spark, docs, none):
    path = queries.vocabulary("word_bpe_49k.json")
    encoder = Encoder(path)
    for group in (60_000, 3):
        got = packing.pack_documents(docs, path, capacity=16, group=group).collect()
        want = []
        for doc, text, *_ in ROWS:
            ids = encoder.plain([text or ""])[0] + b"\0\0\0\0"
            want += [(doc, k // 64, k // 4, len(ids[k : k + 64]) // 4, zlib.crc32(ids[k : k + 64])) for k in range(0, len(ids), 64)]
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 16
        assert len(places) <= 1.05 * math.ceil(sum(w[3] for w in want) / 16) + 2
    assert packing.pack_documents(none, path).count() == 0


def test_packing_of_lengths_that_do_not_combine(spark):
    def packed(lengths, capacity, group):
        rows = [(k, 0, 0, n, 0, k, False) for k, n in enumerate(lengths)]
        own = {}
        for r in packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity, group).collect():
            own.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(n for x in own.values() for _, n in x) == sorted(lengths)
        for x in own.values():
            assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= capacity
        return len(own)

    levels = []
    real, packing.pack_groups = packing.pack_groups, lambda *x: levels.append(x) or real(*x)
    try:
        assert packed([9] * 200, 16, 1) == 200 and len(levels) == 1
        levels.clear()
        assert packed([9] * 100 + [7] * 100, 16, 4) <= 125 and len(levels) <= 6  # groups of four
        assert packed([5] * 300, 16, 4) <= 125
    finally:
        packing.pack_groups = real


def test_halves_are_joined():
    where, offsets, gaps = packing.join_halves(np.arange(6), np.zeros(6, np.int64), np.array([10, 9, 9, 8, 3, 0]), 16)
    size = np.bincount(where, [6, 7, 7, 8, 13, 16], 6)
    assert size.max() <= 16 and sum(0 < n <= 8 for n in size) <= 1
    for k in set(where.tolist()):
        assert gaps[k] == 16 - size[k]


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 30, 200)
    where, offsets, gaps = packing.sum_of_squares(lengths, 30)
    open_gaps: list[int] = []
    squares = lambda g: sum(n * n for x, n in Counter(g).items() if x)
    for k, s in enumerate(lengths.tolist()):
        costs = {b: squares([*open_gaps[:b], open_gaps[b] - s, *open_gaps[b + 1 :]]) for b, g in enumerate(open_gaps) if g >= s}
        fresh = squares([*open_gaps, 30 - s])
        took = int(where[k])
        assert (costs[took] if took < len(open_gaps) else fresh) == min([*costs.values(), fresh])
        open_gaps[took : took + 1] = [(open_gaps[took] if took < len(open_gaps) else 30) - s]
    assert gaps.tolist() == open_gaps


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.text): r for r in line_dedup.report(docs).collect()}
    texts = {d: t for d, t in got}
    assert "The river ran past the mill." in texts[7]
    assert "old willow" not in texts[8] and texts[8].startswith("Eight begins") and texts[8].endswith("unlike the others.")
    assert sorted((r.doc_id, r.text) for r in line_dedup.report(docs).collect() if r.doc_id in (1, 2)) == [(1, ROWS[0][1]), (2, ""), (2, "")]
    assert texts[3] is None and texts[4] == "" and texts[5] == " \n\t "
    kept = line_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id in (3, 4, 5)").count() == 3
    assert line_dedup.remove_repeats(none).count() == 0


def brute_cut(text):
    """Lines as lists of words: natural ends first, then long lines behind words of locally smallest hash."""
    def hashed(word):
        x = sum(b * pow(0x9E3779B97F4A7C55, k, 1 << 64) for k, b in enumerate(word.encode())) % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % (1 << 64)
        return x ^ x >> 31

    out = []
    for natural in re.split(r"(?<=\n)|(?<=[.!?] )|(?<=[\u3002\uff01\uff1f])", text.lower()):
        words, at = natural.split(), 0
        h = [hashed(w) for w in words]
        if len(words) > 10:
            for k in range(3, len(words) - 4):
                if all(h[k] < h[k + d] for d in (-3, -2, -1, 1, 2, 3)):
                    out.append(words[at : k + 1])
                    at = k + 1
        if words[at:]:
            out.append(words[at:])
    return out


def brute_lines(rows):
    """Per row in the order given: the number of lines and which of them go; windows one after the other, in order of document id and row."""
    seen, out = {}, [None] * len(rows)
    for n, (doc, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        own = brute_cut(text or "")
        size, gone = min(3, len(own)), set()
        for k in range(len(own) - size + 1 if own else 0):
            window = tuple(" ".join(w) for w in own[k : k + size])
            if (first := seen.setdefault(window, (n, k))) != (n, k):
                begin = max(k, first[1] + size) if first[0] == n else k
                gone |= set(range(begin, k + size))
        out[n] = (doc, own, gone)
    return out


def test_line_dedup_is_brute_force(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    got = sorted([(r.doc_id, r.n_lines, r.n_removed, (r.text or "").lower().split()) for r in line_dedup.report(real).collect()], key=key)
    want = [(doc, len(own), len(gone), [w for k, line in enumerate(own) for w in line if k not in gone]) for doc, own, gone in brute_lines(rows)]
    assert got == sorted(want, key=key)


def test_line_pieces_are_the_text(real):
    for text in [r.text for r in real.limit(100).collect() if r.text] + ["", " ", "\n\n a b. c\n", LONG, "\U0010ffff a. b\u3002c", "\u4e00\u3002\u4e8c\uff01 x"]:
        pieces, line, words = line_dedup.lines(text)
        assert line_dedup.Layout([line_dedup.plain(text)]).words.tolist() == words.tolist()
        assert "".join(pieces) == text
        own = {}
        for p, k in zip(pieces, line.tolist(), strict=True):
            own.setdefault(k, []).extend(p.lower().split())
        assert [own[k] for k in range(len(words))] == brute_cut(text) and [len(w) for w in brute_cut(text)] == words.tolist()


def test_passages_inside_sentences_go(spark):
    """Passages of 50 words and more that begin and end inside long sentences."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, planted = [], []
    for n in range(200):
        passage = [str(w) for w in rng.choice(vocabulary, int(rng.integers(50, 90)))]
        for k in range(int(rng.integers(15, 30)), len(passage), int(rng.integers(15, 30))):
            passage[k] += "."
        for doc in (2 * n, 2 * n + 1):
            rows.append((doc, " ".join([*map(str, rng.choice(vocabulary, 30)), *passage, *map(str, rng.choice(vocabulary, 30))])))
        planted.append(len(passage))
    got = {r.doc_id: r.words_removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[2 * n] == 0 for n in range(200))
    assert all(got[2 * n + 1] > 0 for n in range(200)) and sum(got.values()) > 0.8 * sum(planted)
    assert all(got[2 * n + 1] <= planted[n] for n in range(200))


def test_short_repeated_lines_go(spark):
    menu, han = "Home\nNews\nContact\n", "第一行的文字\n第二行的文字\n第三行的文字\n"
    rows = [(k, f"{x}own text of number {k} is here\n") for k, x in enumerate([menu, menu, han, han, "One.\n"])]
    seen, want = set(), []
    for d, text in rows:  # no cut by words
        own = text.lower().splitlines()
        gone = set()
        for k in range(max(1, len(own) - 2)):
            window = tuple(own[k : k + 3])
            gone |= set(range(k, k + len(window))) if window in seen else set()
            seen.add(window)
        want.append((d, len(gone)))
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == want == [(0, 0), (1, 3), (2, 0), (3, 3), (4, 0)]
    assert {r.doc_id: r.text for r in got}[3] == "own text of number 3 is here\n"


def brute_weights(texts):
    """Weights of the shingles of each text, from strings: counts times the damped inverse frequency of the shingle's bucket."""
    from marlstone.llm.near_dup import DF_BITS, STRENGTH

    bags, df = [], Counter()
    for text in texts:
        w = words(text)
        size = min(5, len(w))
        bag = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if w else Counter()
        bags.append(bag)
    bucket = {}
    for bag in bags:
        for shingle in bag:
            if shingle not in bucket:
                h, _ = near_dup.shingles(" ".join(shingle).encode())  # the bucket is a property of the hash
                bucket[shingle] = int(h[0]) >> (64 - DF_BITS)
        df.update(bucket[s] for s in bag)
    n = max(1, sum(bool(b) for b in bags))
    idf = {k: 1 + STRENGTH * math.log((1 + n) / (1 + min(c, n))) / math.log(1 + n) for k, c in df.items()}
    return [{s: c * idf[bucket[s]] for s, c in bag.items()} for bag in bags]


def brute_jaccard(a, b):
    least = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return least / (sum(a.values()) + sum(b.values()) - least) if least else 0.0


def brute_classes(rows, threshold=0.8):
    bags = brute_weights([t for _, t in rows])
    having = {}
    for k, bag in enumerate(bags):
        for s in bag:
            having.setdefault(s, []).append(k)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    pairs = []
    for a, bag in enumerate(bags):
        for b in {k for s in bag for k in having[s] if k < a}:
            if (j := brute_jaccard(bag, bags[b])) >= threshold:
                pairs.append((a, b, j))
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return sorted((d, min(g)) for g in groups.values() for d in g), pairs


def test_near_duplicates_are_brute_force(spark, real):
    base = real.select("doc_id", "text").collect()
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in base]
    chain = base[5].text.split()[:120]
    for k in range(60):  # a cloud of copies around one text, linked at the edge of the threshold
        own = list(chain)
        for at in rng.integers(0, len(own), 4):
            own[at] = f"edit{k}x{at}"
        rows.append((10_000 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id) for r in near_dup.report(docs).collect())
    want, _ = brute_classes(rows)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 1  # a link at the very threshold can be missed by all bands


def test_near_duplicate_recall_at_the_threshold(spark):
    """Pairs whose similarity is between 0.8 and 0.9: the share that one class holds."""
    rng = np.random.default_rng(9)
    rows = []
    for n in range(1500):
        own = [f"t{n}w{k}" for k in rng.integers(0, 400, 200)]
        rows.append((2 * n, " ".join(own)))
        for at in rng.choice(200, int(rng.integers(2, 5)), replace=False):
            own[at] = f"edit{at}"
        rows.append((2 * n + 1, " ".join(own)))
    _, pairs = brute_classes(rows)
    near = {(rows[b][0], rows[a][0]) for a, b, j in pairs if j <= 0.9}
    got = {r.doc_id: r.class_id for r in near_dup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(near) > 700 and sum(got[a] == got[b] for a, b in near) >= 0.998 * len(near)
    assert all(got[2 * n] == 2 * n for n in range(1500))  # and no two texts of different pairs


def test_hot_bucket_with_outliers(spark, monkeypatch):
    """A bucket of many copies and a few others: rows grow with the others, not with the square."""
    members = spark.range(5000).select(F.lit(0).alias("band"), F.lit(7).cast("bigint").alias("bucket"), F.col("id").alias("key"), F.when(F.col("id") < 4990, 0).otherwise(F.col("id")).cast("bigint").alias("label"))
    rows = near_dup.dealt(members)
    assert rows.count() <= 4990 + 10 * (-(-4990 // near_dup.BLOCK) + 1)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    small = members.filter("key > 4975")
    met = [sorted((r.side, r.block, r.key, r.label) for r in own) for own in _by(near_dup.dealt(small).collect(), ("band", "bucket", "i", "j"), ("side", "block", "key", "label"))]
    pairs = Counter()
    for own, (i, j) in zip(met, _ids(near_dup.dealt(small).collect()), strict=True):
        part = [0] * len(own) if i == j else [x[0] if j < 0 else x[1] for x in own]
        for a in range(len(own)):
            for b in range(a):
                if own[a][3] != own[b][3] and (i == j or part[a] != part[b]):
                    pairs[tuple(sorted((own[a][2], own[b][2])))] += 1
    ids = [r.key for r in small.collect()]
    label = {r.key: r.label for r in small.collect()}
    assert set(pairs) == {tuple(sorted((a, b))) for a in ids for b in ids if a < b and label[a] != label[b]} and set(pairs.values()) == {1}


def _by(rows, keys, values):
    from types import SimpleNamespace

    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(SimpleNamespace(**{v: r[v] for v in values}))
    return [out[k] for k in sorted(out)]


def _ids(rows):
    return [(i, j) for _, _, i, j in sorted({(r.band, r.bucket, r.i, r.j) for r in rows})]


def test_near_duplicates_edge_rows(docs, none):
    got = sorted([(r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dup.report(docs).collect()], key=key)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False)]
    assert all(s == 1 and k for d, _, s, k in got if d in (3, 4, 5))
    kept = near_dup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert near_dup.report(none).count() == 0 and near_dup.drop_copies(none).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.uniform(0.5, 3, len(h))
    a, b = slice(0, 360), slice(40, len(h))
    s = near_dup.Sampler()
    x, y = (s.signatures(h[p], w[p], np.array([0]))[:, 0] for p in (a, b))
    assert abs((x == y).mean() - near_dup.similarity((h[a], w[a]), (h[b], w[b]))) < 0.2


def test_rules_match_sql(spark, docs, none, sf):
    import duckdb

    got = rules.verdicts(docs).collect()
    assert len(got) == len(ROWS) and rules.verdicts(none).count() == 0
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words_removed"]
    want = sorted(con.sql(f"select {', '.join(columns)} from ({rules.ORACLE})").fetchall())
    assert sorted(map(tuple, queries.op7_rules(spark, sf).select(columns).collect())) == want
    hosts = [(None, "x y\nz", None), (1, "x y", "h"), (1, "x y", "h")] + [(100 + k, "big host line\nown words of row " + str(k), "big") for k in range(300)] + [(500 + k, "seldom seen line\nmore words " + str(k), "big") for k in range(20)]
    odd = spark.createDataFrame(hosts, "doc_id bigint, text string, source string")
    n = {(r.doc_id, r.n_line_words_removed) for r in rules.verdicts(odd).collect()}
    assert (100, 3) in n and (500, 0) in n and (1, 0) in n and (None, 0) in n  # 20 documents are not more than 20; a tenth of a large host isn't needed
    often = spark.createDataFrame([(k, f"shared line\nown text {k} and more words", "h") for k in range(30)], "doc_id bigint, text string, source string")
    cut = rules.without_frequent_lines(often)
    assert cut.columns == often.columns and cut.filter("text like '%shared%'").count() == 0 and cut.filter("text like 'own text%'").count() == 30


def test_token_files_round_trip(docs, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    encoder = Encoder(path)
    segments = token_files.write_segments(docs, path, end=2, segment=50_000, partitions=3)
    got = sorted(token_files.read_documents(segments, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in ROWS], key=lambda d: (d is not None, d or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((d, encoder.plain([t or ""])[0] + b"\2\0\0\0") for d, t, *_ in ROWS)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    every = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4")
    for k in (0, 1, len(every) // 2, len(every) - 1):
        assert token_files.read_token(segments, k) == every[k]
    assert token_files.read_documents(token_files.write_segments(none, path, end=2)).count() == 0


def test_addressable_codes_read_any_place():
    ids = np.random.default_rng(0).choice([0, 1, 255, 256, 65_535, 65_536, 2**32 - 1], 3000).astype(np.uint32)
    image = token_files.Image(token_files.encode_image(ids, [None, 4], np.array([1000, 2000])))
    assert image.ids().tolist() == ids.tolist() and [image[k] for k in range(3000)] == ids.tolist() and image.docs == [None, 4]


def test_class_lm_base_scores(spark, sf, real, none):
    rows = [(r.doc_id, r.text) for r in real.collect()] + [(d, t) for d, t, *_ in ROWS[:6]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = lambda d: common.crc32_text(d) % 7 == 2
    count, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = []
    for d, t in rows:
        c = [count[w] for w in (t or "").encode().lower().split()] + [ends]
        want.append((d, held(d), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 6)))
    got = class_lm.score(docs, chunk=20_000).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    aside = [r for r in got if r.held_out]
    assert sum(r.score for r in aside) > sum(r.base_score for r in aside)  # lower perplexity on texts it has not seen
    assert class_lm.score(none).count() == 0
    untrained = class_lm.score(docs.limit(5), F.lit(True)).collect()
    assert all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0) and r.held_out for r in untrained) and len(untrained) == 5


def test_class_lm_score_is_brute_force(spark, real):
    """The score from the classes of the words and plain counts of class pairs."""
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in real.limit(120).collect()] + [(d, t) for d, t, *_ in ROWS[:7]], "doc_id bigint, text string")
    held = lambda d: common.crc32_text(d) % 7 == 2
    chunks = class_lm.chunked(docs, common.crc_mod("doc_id", 7) == 2, 5_000)
    counts = class_lm.Counts(chunks)
    names = {}  # the words of each chunk
    for r in chunks.collect():
        names[r.chunk] = [bytes(w) for w in r.words]
    table, kind, _ = class_lm.placed(class_lm.coded(chunks, counts.symbols(), {"c": "<u8", "symbols": "<u4"}), counts)
    classes = {}
    for row in table.collect():
        own = class_lm.Chunk(row.asDict(), counts.ends)
        for w, c, k in zip(own.words.tolist(), own.c.tolist(), kind[own.symbols].tolist(), strict=True):
            if w >= 0 and c:
                assert classes.setdefault(names[row.chunk][w], k) == k  # a word has one class in all chunks
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    count = Counter(w for d, own in rows if not held(d) for w in own)
    n, end, unseen = class_lm.CLASSES, "end", "unseen"
    name = lambda w: classes[w] if count[w] else unseen
    # half of the mass of words seen once stands for unseen words, before and behind
    parts = lambda w: [(end, 1.0)] if w is None else [(classes[w], 0.5), (unseen, 0.5)] if count[w] == 1 else [(classes[w], 1.0)]
    pairs = Counter()
    for d, own in rows:
        before = None  # a document begins behind an end
        for w in [*own, None]:
            if not held(d):
                for a, x in parts(before):
                    for b, y in parts(w):
                        pairs[a, b] += x * y
            before = w
    every = [*range(n), unseen, end]
    mass, total = Counter(), Counter()
    for (a, b), x in pairs.items():
        mass[b] += x
        total[a] += x
    prior = {k: (mass[k] + 1) / (sum(mass.values()) + len(every)) for k in every}
    want = []
    for d, own in rows:
        score, a = 0.0, end
        for w in [*own, None]:
            b = end if w is None else name(w)
            score += math.log10((pairs[a, b] + 20 * prior[b]) / (total[a] + 20))
            c = counts.ends if w is None else count[w] * (0.5 if count[w] == 1 else 1)
            if c:
                score += math.log10(c / max(mass[b], 1))
            a = b
        want.append((d, round(score, 4)))
    got = [(r.doc_id, round(r.score, 4)) for r in class_lm.score(docs, chunk=5_000).collect()]
    for (d, x), (e, y) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert d == e and abs(x - y) < 1e-3 + 1e-6 * abs(y)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(1.5, (40, 40))

    def fit(kind):
        t = np.zeros((8, 8))
        np.add.at(t, (kind[:, None], kind[None, :]), pairs.astype(float))
        return class_lm.xlogx(t).sum() - class_lm.xlogx(t.sum(0)).sum() - class_lm.xlogx(t.sum(1)).sum()

    kinds = [class_lm.exchange(pairs, 6, r) for r in (0, 1, 5)]
    assert fit(kinds[0]) < fit(kinds[1]) <= fit(kinds[2]) + 1e-9


def test_every_seen_word_moves_to_its_best_class(spark, real):
    def fit(t):
        return class_lm.xlogx(t).sum() - class_lm.xlogx(t.sum(0)).sum() - class_lm.xlogx(t.sum(1)).sum()

    rng = np.random.default_rng(5)
    ids, own = rng.integers(0, 30, 4000), rng.integers(0, 6, 32)
    own[30:] = 6, 7
    ids[::50] = 31
    pairs = np.zeros((32, 32))
    np.add.at(pairs, (ids, np.roll(ids, -1)), 1)

    def folded(kind):
        t = np.zeros((8, 8))
        np.add.at(t, (kind[:, None], kind[None, :]), pairs)
        return t

    right, left = (np.array([np.bincount(own, p[w], 8) for w in range(30)]) for p in (pairs, pairs.T))
    alone = np.diag(pairs)[:30]
    for side in (right, left):
        side[np.arange(30), own[:30]] -= alone
    best = class_lm.best_classes(right, left, alone, own[:30], folded(own))
    for w in range(30):
        tried = [fit(folded(np.where(np.arange(32) == w, k, own))) for k in range(6)]
        assert tried[best[w]] >= max(tried) - 1e-6

    docs = real.select("doc_id", "text")
    chunks = class_lm.chunked(docs, F.lit(False), 20_000)
    counts = class_lm.Counts(chunks)
    table = class_lm.coded(chunks, counts.symbols(), {"c": "<u8", "symbols": "<u4"})
    table, kind, _ = class_lm.placed(table, counts)
    assert counts.v > 2 * class_lm.TOP
    spread = {}
    for row in table.collect():
        own = class_lm.Chunk(row.asDict(), counts.ends)
        for c, w in zip(own.c.tolist(), kind[own.symbols].tolist(), strict=True):
            spread.setdefault(c, set()).add(w)
    assert len(spread[1]) > 10 and len(spread[2]) > 10  # not one class for all words of a count
    per = {p: sum(r.score for r in class_lm.score(docs, chunk=20_000, passes=p).collect() if r.held_out) for p in (0, 2)}
    assert per[2] > per[0]


def test_chat_escapes_and_reads_back():
    said = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<\\s>", "<s", "[/INST", "[SYS]\\[/SYS]", "[ROLE:x] y [/ROLE]", " [INST] ", "é\n\n"]
    for text in said:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[/ROLE]"))
    turns = [(role, t) for t in said for role in ("system", "user", "assistant", "tool] x", "")]
    text, mask = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True)] == [t for r, t in turns if r == "assistant"]


def test_chat_chooses_branches(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 5.0, "assistant", "good"), (1, 4, 3, 2.0, "user", "more"), (1, 5, 4, 9.0, "assistant", "done"), (2, 1, 99, 0.0, "user", "orphan"), (3, 1, 2, 0.0, "user", "ring"), (3, 2, 1, 0.0, "user", "ring")]
    messages = spark.createDataFrame(rows, "tree bigint, id bigint, parent bigint, score double, role string, text string")
    best = {r.tree: chat.parse(r.formatted) for r in chat.format_trees(messages).collect()}
    empty = messages.limit(0)
    assert chat.format_trees(empty).count() == 0
    ring = spark.createDataFrame([(9, 1, 3, 0.0, "user", "a"), (9, 2, 1, 0.0, "user", "b"), (9, 3, 2, 0.0, "user", "c"), (8, 1, None, None, None, None)], messages.schema)
    assert {r.tree: chat.parse(r.formatted) for r in chat.format_trees(ring).collect()} == {8: [("", "")]}
    assert best == {1: [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "done")], 2: [("user", "orphan")]}
    both = {(r.tree, r.path): chat.parse(r.formatted)[-1][1] for r in chat.format_trees(messages, 2).collect()}
    assert both == {(1, 1): "done", (1, 2): "bad", (2, 1): "orphan"}


def test_chat_digests(spark, sf):
    got = {r.conv_id: r for r in queries.op10_chat(spark, sf).collect()}
    rows = {}
    for r in common.read(spark, sf, "conversations").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(rows)
    for k, own in rows.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest())
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    odd = spark.createDataFrame([(None, 1, "user", None), (None, None, None, "x"), (5, 1, "user", "a"), (5, 1, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert sorted([(r.conv_id, r.n_turns) for r in chat.conversation_digests(odd).collect()], key=key) == [(None, 2), (5, 2)]
    assert chat.conversation_digests(odd.limit(0)).count() == 0


def test_language_held_out(spark, sf, docs, none):
    truth = {r.doc_id: r.lang for r in common.read(spark, sf, "documents").collect()}
    got = queries.op5_language(spark, sf).collect()
    aside = [r for r in got if r.held_out]
    assert all(r.held_out == (common.crc32_text(r.doc_id) % 3 == 1) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in aside) >= 0.97 * len(aside)
    odd = language.identify(docs).collect()
    assert len(odd) == len(ROWS) and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (3, 4, 5))
    assert language.identify(none).count() == 0 and language.drop_unidentified(docs).columns == docs.columns


def test_rare_languages_are_learnt(spark):
    """A language of a few rows beside a group of copies that holds most rows."""
    rows = [(k, "the river ran past the old mill and nobody had seen the miller", "en") for k in range(3000)]
    rows += [(4000 + k, f"der fluss {k} lief an der alten muehle vorbei und niemand sah den mueller {k % 7}", "de") for k in range(400)]
    rows += [(5000 + k, f"joki {k} virtasi vanhan myllyn ohi eika kukaan ollut nahnyt myllaria", "fi") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = [language.train(docs.repartition(n).select("text", "lang"), 100) for n in (1, 5)]
    assert models[0].languages == ["de", "en", "fi"] and np.array_equal(models[0].weights, models[1].weights)
    assert models[0].predict(["joki virtasi ohi", "der alte fluss", "the river ran past the old mill and nobody had seen the miller", None])[0] == ["fi", "de", "en", "und"]
    assert common.quotas({"a": 3, "b": 400, "c": 1000}, 100) == {"a": 3, "b": 48, "c": 49}
    assert language.drop_unidentified(docs.limit(0)).count() == 0


def test_quality_learns_from_each_label_once(spark):
    rows = [(k, ("good words in a row " if k % 2 else "$$ BUY NOW !! ") * 5 + str(k)) for k in range(60)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 3 + [(None, 1), (3, None)], "doc_id bigint, quality int")
    vectors = quality.pooled(docs, quality.word_vectors(docs))
    once, thrice = quality.train(vectors, labels.distinct(), 40), quality.train(vectors, labels, 40)
    assert all(np.array_equal(a, b) for a, b in zip(once.params, thrice.params, strict=True))


def test_quality_held_out(spark, sf, docs, none):
    truth = {r.doc_id: r.quality for r in common.read(spark, sf, "labels").collect()}
    got = queries.op3_quality(spark, sf).collect()
    aside = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in aside) >= 0.85 * len(aside)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    odd = quality.score(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert quality.score(none, labels.limit(0)).count() == 0


def test_pipeline_is_brute_force(spark, sf):
    """Each stage on its own input against a plain version of it."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = common.read(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in common.read(spark, sf, "benchmark").collect()]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        after = common.materialise(stage(spark, docs, sf), name)
        rows = [r.asDict() for r in after.collect()]
        if name == "packing":
            library, want = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), []
            for r in before:
                ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
                want += [(r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
            assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
            places = {}
            for r in rows:
                places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert all(sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] for own in places.values())
            break
        assert after.columns == columns
        kept = {r["doc_id"]: r for r in rows}
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows) and len(rows) > 0.85 * len(before)
        elif name == "line_dedup":
            for doc, own, gone in brute_lines([(r["doc_id"], r["text"]) for r in before]):
                left = [w for k, line in enumerate(own) for w in line if k not in gone]
                assert (doc in kept) == (not gone or bool(left)) and (doc not in kept or kept[doc]["text"].lower().split() == left)
        elif name == "near_dup":
            want, _ = brute_classes([(r["doc_id"], r["text"]) for r in before])
            assert len({d for d, c in want if d == c} ^ set(kept)) <= 1
        else:
            hit = {d for d, *_, bad in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if bad}
            gone = {r["doc_id"] for r in before} - set(kept)
            assert hit <= gone and len(gone - hit) <= 0.02 * len(before)  # what goes beside is near a passage
        docs = after
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.collect()} == {r["doc_id"] for r in before}


def test_results_can_be_cleared(spark):
    kept = common.materialise(spark.range(3).toDF("x"), "clear")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file:").replace("//", "/")
    import os

    assert os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path)
