"""Whitening, product codes and byte-level BPE against plain re-statements; hashes against texts that defeat polynomials."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import SCHEMA, awkward
from tokenizers import Tokenizer

from parcelspark.llm import bpe, codes, common, decontamination, lexicon, licenses, minhash, passages, quality, queries, vectors, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, n long, size int, component int, code string, slot int, entry int, _label string, salt int"


def vector_rows(n=60, size=16, seed=3):
    """Vectors with every unusable kind among them, ties, repeated rows and ids, and a null id and labels."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.2, size).astype(np.float32).tolist(), i % 3) for i in range(n)]
    rows += [(7, rows[7][1], 1), (200, rows[3][1], None), (201, rows[3][1], None), (None, rows[4][1], 2)]
    rows += [(300, None, 0), (301, [], 0), (302, [None] * size, 0), (303, [math.nan] + [0.1] * (size - 1), 1)]
    rows += [(304, [math.inf] + [0.1] * (size - 1), 1), (305, [0.1] * (size - 1), None), (306, [0.0] * size, 2)]
    rows.append((307, [-0.0, 1.0 / 4096, -1.0 / 4096, 1e-9, -1e-9] + [0.25] * (size - 5), 2))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, *["7"], 1, 2, 3, "00", 4, 5, "z", 6) for i, v, c in rows], VECTORS).repartition(3)


def usable(rows, size):
    return [(i, v, c) for i, v, c in rows if v is not None and len(v) == size and all(a is not None and math.isfinite(a) for a in v)]


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors_):
    """(n, deviations, exact covariance as fractions) of lists of floats."""
    x = [[math.floor(64 * a) + 1_000_000 for a in v] for v in vectors_]
    n, size = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(size)]
    d = [[n * r[k] - sums[k] for k in range(size)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(size)] for i in range(size)]
    return n, [sum(a * a for a in r) for r in d], cov, d


def test_whitening_against_fractions(spark):
    rows = vector_rows(120)
    good = usable(rows, 16)
    n, deviations, cov, d = plain_whitening([v for _, v, _ in good])
    out = whitening.whiten(table(spark, rows), 10).toPandas()
    assert len(out) == 10 * len(good) and set(out.n) == {n}
    want = sorted(zip([-1 if i is None else i for i, _, _ in good], deviations, strict=True))
    first = out[out.component == 1]
    assert sorted(zip(first.vec_id.fillna(-1).astype(int), first.deviation, strict=True)) == want
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    trace = float(sum(cov[i][i] for i in range(16)))
    for k in range(10):
        own = out[out.component == k + 1]
        assert np.allclose(own.explained, values[-1 - k] / trace, rtol=1e-12)
        plain = np.array(d) / n @ axes[:, -1 - k] / math.sqrt(values[-1 - k])
        assert np.allclose(sorted(np.abs(own.whitened)), sorted(np.abs(plain)), atol=1e-9)
    assert set(out.identity_error) == {out.identity_error[0]} and out.identity_error[0] < 1e-9


def test_whitening_is_exact_where_doubles_are_not(spark):
    """Large entries far from 0: products of uncentred entries would lose the spread."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(2.0**30)) * (1 + k) + float(v) for k, v in enumerate(rng.integers(0, 3, 5))], 0) for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "vec_id long, embedding array<double>").repartition(4)
    e = vectors.extent(df, 64, 1_000_000, lambda _: 45)
    centre = whitening.Centre.of(e)
    n, deviations, cov, _ = plain_whitening([v for _, v, _ in rows])
    scatter = whitening.exact_scatter(df, e, centre)
    assert [[Fraction(v, n**3) for v in r] for r in scatter.tolist()] == cov
    out = whitening.whiten(df).toPandas()
    assert sorted(out[out.component == 1].deviation) == sorted(deviations) and out.identity_error[0] < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25, 1.0]) for i in range(4)], "vec_id int, embedding array<float>")
    out = whitening.whiten(same).collect()
    assert len(out) == 12 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(4, 0, None, None, None)}
    two = spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    out = {(r.vec_id, r.component): r for r in whitening.whiten(two).collect()}
    assert out[1, 1].explained == 1.0 and abs(out[1, 1].whitened) == pytest.approx(1) and out[1, 2].whitened is None and out[2, 2].identity_error < 1e-12
    for rows in ([], [(1, None)], [(1, [])], [(1, [math.nan])]):
        empty = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError, match="45 bits"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))
    with pytest.raises(TypeError):
        whitening.whiten(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i % 2) * 2.0**38]) for i in range(8)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out} == {None} and {round(abs(r.whitened), 9) for r in out} == {1.0}


@given(st.lists(st.integers(-(10**40), 10**40), min_size=1, max_size=6))
def test_residues_give_the_numbers_back(numbers):
    moduli = whitening.primes(2 * 10**40 + 1)
    assert all(p < 1 << whitening.PRIME_BITS and all(p % q for q in range(2, 1500) if q < p) for p in moduli[:2])
    got = whitening.from_residues([np.array([v % p for v in numbers]) for p in moduli], moduli)
    assert got.tolist() == numbers


# ---------------------------------------------------------------- codes


def plain_codes(rows, size, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) rows and the books' digest, by all exact distances."""
    good = [(i, [math.floor(4096 * float(a)) for a in v], c) for i, v, c in usable(rows, size)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    edges = [p * size // parts for p in range(parts + 1)]
    books = [[r[1][a:b] for r in good[:entries]] for a, b in zip(edges, edges[1:], strict=False)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own = defaultdict(list)
            for r in good:
                own[near(r[1][a:b], books[p])[1]].append(r[1][a:b])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, x, c in good:
        found = [near(x[a:b], books[p]) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), c))
        by_label[c] += out[-1][2]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted([(i, code, e, by_label[c], digest) for i, code, e, c in out], key=str)


@pytest.mark.parametrize(("n", "size"), [(60, 16), (60, 13), (5, 16), (40, 6)])
def test_codes_against_all_distances(spark, n, size):
    rows = vector_rows(max(n, 8), size)[: None if n > 10 else 3]
    got = [tuple(r) for r in codes.compressed(table(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_codes(rows, size)


def test_codes_of_tables_without_vectors(spark):
    out = codes.compressed(table(spark, [(1, None, 1), (2, [], 2)]))
    assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="bits"):
        codes.compressed(table(spark, [(1, [1e30], 1)]))


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 12), st.integers(1, 16), st.integers(1, 40), st.integers(0, 2**20), st.integers(0, 10**6))
def test_nearest_is_what_all_distances_give(size, k, n, spread, seed):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-spread - 1, spread + 1, (n, size)), rng.integers(-spread - 1, spread + 1, (k, size))
    e[k // 2] = e[0]  # ties
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    code, error = codes.nearest(x, e)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


def test_bounds_keep_few_entries():
    """Most entries fall before an exact distance on vectors in clusters."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-20, 20, (4000, 8))
    means, rest = codes._segments(x.astype(float), codes.cuts(8, 2))
    other, others = codes._segments(centres.astype(float), codes.cuts(8, 2))
    bound = 4 * ((means[:, None] - other[None]) ** 2).sum(2) + ((rest[:, None] - others[None]) ** 2).sum(2)
    exact = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (bound <= exact + 1e-6).all()
    assert (bound <= exact.min(1)[:, None]).sum(1).mean() < 2


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def arrays():
    vocabulary = lexicon.read_vocabulary(PATH)
    words = [b" the", b" of", b"!", b"'s", b"don", b"\n", " é".encode(), b"the", b" then", b"en"]
    return vocabulary, words, bpe.character_classes()


@pytest.fixture(scope="module")
def compiled(arrays, tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "file"
    path.write_bytes(lexicon.compiled(*arrays))
    return lexicon.mapped(str(path))


PIECES = [
    "a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'LL", "'", "1", "2", "é", "中", "🙂", "<|endoftext|>", "<|endof", "!", "\t", "x", "the", " don't",
    "　", "́", "٣", "ʼ", "\x1c", "\r\n", " ", "՘", " the then", "\x00", "_", "\u0085", "ſ", "Ⅷ",
]


def test_words_and_ids_are_the_librarys(library, compiled):
    rng = random.Random(4)
    cutter = bpe.Cutter(compiled)
    for _ in range(60):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(40)] + [None, ""]
        texts += ["<|endof", "text|>"]  # what only arises where two texts meet is no token
        for _, data, offsets in bpe.parts(pa.array(texts), 700):
            assert len(data) <= 700 or len(offsets) == 2
        got = []
        for _, data, offsets in bpe.parts(pa.array(texts)):
            ids, edges = bpe.token_ids(compiled, cutter, data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert got == want
        decoded = [bpe.piece_bytes(compiled, np.array(i, np.uint32)).decode(errors="replace") for i in got]
        assert decoded == [library.decode(i, skip_special_tokens=False) for i in want] == [t or "" for t in texts]


def test_character_classes_are_those_of_the_librarys_words(library, arrays):
    """Every code point beside a letter, a digit and a sign: it joins the one of its own kind."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for beside, kind in (("x", bpe.LETTER), ("1", bpe.DIGIT), ("!", bpe.SIGN)):
        text = "".join(f"{beside}{chr(c)}\n" for c in points)
        begins = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(text)}
        joins = np.array([3 * k + 1 not in begins for k in range(len(points))])
        assert (joins == (arrays[2][points] == kind)).all()


def test_long_words_and_all_lexicons_agree(library, arrays):
    vocabulary = arrays[0]
    rng = random.Random(9)
    long = ["a" * 4000, "ab" * 2000, "thequickbrown" * 300, "".join(rng.choice("abcdefghij") for _ in range(9000)), "é" * 999, "0" * 997, "=" * 300]
    short = ["a" * 200, "banana", "é" * 20, "0" * 256, "x", "".join(rng.choice("etaoin") for _ in range(256))]
    want = [library.encode(w, add_special_tokens=False).ids for w in long + short]
    assert [i.tolist() for i in lexicon.merged_words(vocabulary, [w.encode() for w in long + short])] == want
    assert [lexicon.merged_long(vocabulary, w.encode()).tolist() for w in short] == want[len(long) :]
    assert lexicon.merged_short(vocabulary, [long[0].encode()])[0].tolist() == want[0]


@settings(deadline=None, max_examples=40)
@given(st.sets(st.binary(min_size=1, max_size=5), max_size=60), st.lists(st.binary(min_size=1, max_size=6), max_size=20))
def test_automaton_is_minimal_and_finds_places(words, others):
    ordered = sorted(words)
    states = lexicon.minimal_automaton(ordered)
    endings = {frozenset(w[k:] for w in words if w.startswith(p)) for w in words or {b""} for k in range(len(w) + 1) for p in (w[:k],)}
    assert len(states) == max(1, len(endings))  # as many states as there are sets of endings
    found = lexicon.transition_table(states)
    asked = ordered + others
    data = np.frombuffer(b"".join(asked), np.uint8)
    lengths = np.array([len(w) for w in asked], np.int64)
    got = lexicon.places(found, data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [ordered.index(w) if w in words else -1 for w in asked]


def test_operator_on_awkward_texts(spark, library):
    rows = awkward()
    long = "word " * 400_000 + "<|endoftext|>   end"
    rows += [(9001, long, *rows[0][2:]), (9001, "x" * 70_000, *rows[0][2:]), (None, "no id", *rows[0][2:]), (9002, "中文字" * 300_000, *rows[0][2:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(((r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows), key=str)
    for most in (0, 50, bpe.LEXICON):
        name = bpe.build(docs, PATH, most)
        out = bpe.encode(docs, name, decode=True).collect()
        got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out), key=str)
        assert got == want and all(r.n_tokens == len(r.ids) // 4 for r in out)
    again = bpe.decode(bpe.encode(docs, name), name).collect()
    assert sorted((tuple(r) for r in again), key=str) == sorted(((i, t) for i, _, t in want), key=str)
    assert bpe.encode(docs.limit(0), bpe.build(docs.limit(0), PATH)).collect() == []


def test_slices_cut_long_texts_between_words(library, compiled):
    cutter = bpe.Cutter(compiled)
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice(PIECES) for _ in range(400))
        ids = [i for _, data, offsets in bpe.parts(pa.array([text]), 64) for i in bpe.token_ids(compiled, cutter, data, offsets)[0].tolist()]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_frequent_words_are_counted_over_all_texts(spark, arrays):
    docs = spark.createDataFrame([(k, "b b b a a c <|endoftext|>" + " z" * (k % 2)) for k in range(50)], "doc_id long, text string").repartition(7)
    cutter = bpe.Cutter(arrays[0] | {"classes": arrays[2]})
    assert bpe.frequent_words(docs, cutter, 5) == [b" a", b" b", b" ", b" c", b"b"]


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        lexicon.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_bytes_that_are_no_text(arrays):
    column = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 3, 5], np.int32)), pa.py_buffer(b"a\xffb\xc3(")])
    cutter = bpe.Cutter(arrays[0] | {"classes": arrays[2]})
    ((_, data, offsets),) = bpe.parts(column)
    data, offsets, *_ = cutter.cut(data, offsets)
    assert data.tobytes() == "a�b�(".encode() and offsets.tolist() == [0, 5, 9]


def test_query_equals_the_library(spark, library):
    out = queries.op12_transducer_bpe(spark, DATA).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        row = out.loc[i]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---------------------------------------------------------------- hashes


def thue_morse(letters: int) -> tuple[str, str]:
    """A word of so many letters, and its complement: they collide under every odd base modulo 2**64."""
    w = ["ab"[bin(i).count("1") % 2] for i in range(letters)]
    return "".join(w), "".join("ba"[c == "b"] for c in w)


@pytest.mark.parametrize("letters", [256, 512, 1024, 2048])
def test_hashes_of_patterned_words_differ(letters):
    one, other = thue_morse(letters)
    assert one != other
    data = np.frombuffer((one + other + one).encode(), np.uint8)
    starts = np.arange(3) * letters
    for seed in (0, common.SECOND_SEED):
        h = common.span_hashes(data, starts, starts + letters, seed)
        assert h[0] == h[2] != h[1]
    words = np.array([5, 9], np.uint64)[[bin(i).count("1") % 2 for i in range(64)] + [1 - bin(i).count("1") % 2 for i in range(64)]]
    h = common.gram_hashes(words, 64)
    assert h[0] != h[64]


@pytest.mark.parametrize("letters", [1024, 2048])
def test_operators_tell_patterned_words_apart(spark, letters):
    one, other = thue_morse(letters)
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {other}"), (3, f"{same} {one}")], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in passages.dedup(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 13}
    # Five words are one shingle: the two texts share none.
    short = spark.createDataFrame([(1, f"a b c d {one}"), (2, f"a b c d {other}"), (3, f"a b c d {one}")], "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(short).collect()}
    assert classes[1] == classes[3] != classes[2]
    templates = spark.createDataFrame([("one", f"{one} x {one}"), ("other", f"{other} x {other}")], "label string, text string")
    scanned = licenses.scan(spark.createDataFrame([(1, f"{one} x {one}"), (2, f"{other} x {other}")], "doc_id long, text string"), templates)
    assert {r.doc_id: r.labels for r in scanned.collect()} == {1: "one", 2: "other"}
    item = spark.createDataFrame([(1, f"{same} {one}")], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontamination.decontaminate(docs, item).collect()}
    assert hit == {1: 13, 2: 0, 3: 13}
    texts = [f"{one} {other}", f"{one} {one}", f"{one} {'a' * letters}"]
    data, offsets = common.text_bytes(pa.array(texts))
    distinct = quality.statistics(data, offsets)[:, 13]
    assert distinct[0] == distinct[2] > distinct[1]


def test_templates_too_short_for_a_gram_are_refused(spark):
    docs = spark.createDataFrame([(1, "in the public domain now")], "doc_id long, text string")
    for text in ("public domain", "", "!"):
        with pytest.raises(ValueError, match="fewer than 3 words"):
            licenses.scan(docs, spark.createDataFrame([("pd", text)], "label string, text string"))


def test_an_item_without_id_hits_and_is_not_listed(spark):
    words = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(1, words), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), (7, "x " + words)], "item_id long, text string")
    for bench, names in ((items, ["7"]), (items.where("item_id is null"), [])):
        got = {r.doc_id: (r.n_hit, r.n_items, r.items, r.contaminated) for r in decontamination.decontaminate(docs, bench).collect()}
        assert got[1] == (15, len(names), names, True) and got[2][0] == 0
