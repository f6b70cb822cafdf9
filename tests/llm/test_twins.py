"""Whole operators against plain re-statements: the mix, the discriminant, the shards, the pipeline; ids and very long texts."""

import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_text_operators import SCHEMA, WORDS, awkward, contamination, targets, weighted_bags

import corpus_pipeline
from parcelspark.llm import decontamination, embeddings, licenses, minhash, mixing, passages, pii, quality, sharding, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


class Int(int):
    """A 32-bit number for ``spark_hash``."""


def spark_hash(*values) -> int:
    """Spark's xxhash64 of a row: each value's hash with the one before as its seed."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Int) else "<q", v)
        h = xxhash.xxh64(raw, seed=h & (2**64 - 1)).intdigest()
    return h - 2**64 if h >= 2**63 else h


def plain_mix(rows, block_words=64, shard_words=1 << 20, seed=7) -> Counter:
    """The mix of (doc_id, size, source) rows, slot by slot: Counter of (doc_id, size, taken)."""
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes)
    n_buckets = max(1, -(-len(rows) // 5000), min(512, -(-len(rows) // 64)))
    places = {}
    for k, s in enumerate(names):
        own = [(spark_hash(*([i] if i is not None else [])) % n_buckets, i is not None, i or 0, n, r) for r, (i, n, src) in enumerate(rows) if src == s]
        start = 0
        for *_, n, r in sorted(own):
            places[r] = (k, start)
            start += n
    blocks = [-(-sizes[s] // block_words) for s in names]
    slots = []
    for s, b in zip(names, blocks, strict=True):
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        rest = max(0.0, want[s] - epochs * sizes[s])
        slots.append(min(epochs * b + int(rest / block_words + 0.5), 3 * b))
    n_slots = sum(slots)
    n_shards = max(1, -(-n_slots * block_words // shard_words))
    ends = np.cumsum(slots)
    drawn = defaultdict(Counter)
    for i in range(n_slots):
        u = spark_hash(Int(seed), "slot", i) % n_slots
        drawn[int(np.searchsorted(ends, u, side="right"))][i * n_shards // n_slots] += 1
    taken_blocks = defaultdict(Counter)
    for k, n in enumerate(slots):
        if not n:
            continue
        counts = drawn[k] or Counter({spark_hash(Int(seed), Int(k)) % n_shards: 1})
        everything, upto, numbers = sum(counts.values()), 0, []
        for shard in sorted(counts):
            numbers += range(upto * n // everything, (upto + counts[shard]) * n // everything)
            upto += counts[shard]
        for slot in numbers:
            epoch, at = divmod(slot, blocks[k])
            for r in range(mixing.ROUNDS):
                other = (spark_hash(Int(seed), Int(k), epoch, Int(r)) % blocks[k] - at) % blocks[k]
                if spark_hash("swap", Int(seed), Int(k), epoch, Int(r), max(at, other)) & 1:
                    at = other
            taken_blocks[k][at] += 1
    out = Counter()
    for r, (i, n, _) in enumerate(rows):
        k, start = places[r]
        out[i, n, sum(taken_blocks[k][w // block_words] for w in range(start, start + n))] += 1
    return out


def sized(rows):
    return [(r[0], len(WORDS.findall(r[1] or "")), r[3]) for r in rows]


def test_mix_slot_by_slot(spark, docs, rows):
    got = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).taken().collect())
    assert got == plain_mix(sized(rows))
    got = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs, block_words=5, shard_words=700).taken().collect())
    assert got == plain_mix(sized(rows), 5, 700)


def plain_statistics(text: str) -> list[float]:
    """The statistics of one text from their definition."""
    data = text.encode()
    words = [w.encode() for w in WORDS.findall(text)]
    lines = [x for x in data.split(b"\n") if x]
    share = lambda chars, usual: np.log((sum(data.count(c) for c in chars) + usual * 120) / (len(data) + 120))
    per_word = lambda n, usual: (n + usual * 20) / (len(words) + 20)
    ascii_ = lambda s: [s[i : i + 1] for i in range(len(s))]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p((len(data) - data.count(b"\n") + 120) / (len(words) + 20)),
        per_word(sum(len(w) <= 3 for w in words), 0.4), per_word(sum(len(w) >= 14 for w in words), 0.04),
        share(ascii_(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 0.02), share(ascii_(b"0123456789"), 0.002), share([b"|"], 0.0005), share([b"!"], 0.0005),
        share(ascii_(b"#$%&*~^<>{}[]=_\\@+/"), 0.001), share(ascii_(b".,;:?"), 0.02), share([b"\n"], 0.006),
        np.sqrt((sum(b >= 128 for b in data) + 0.03 * 120) / (len(data) + 120)),
        np.log((len(set(words)) + 20) / (len(words) + 20)),
        np.log(per_word(sum(a == b for a, b in zip(words, words[1:], strict=False)), 0.01)),
        np.log((len(set(lines)) + 2) / (len(lines) + 2)),
        per_word(sum(sum(map(letter, w)) >= len(w) - 1 for w in words), 0.97),
        np.log1p((len(data) + 150) / (len(lines) + 1)),
    ]


def plain_scores(x: np.ndarray, y: np.ndarray, every: np.ndarray, shrink=0.05) -> np.ndarray:
    """Posterior of label 1 by the two Gaussian densities written out, with inverses and determinants."""
    spread = x.var(0)
    log = []
    for c in (0, 1):
        own = x[y == c]
        cov = np.cov(own.T, bias=True)
        weight = min(1.0, shrink + x.shape[1] / (len(own) + x.shape[1]))
        cov = (1 - weight) * cov + weight * np.diag(np.diag(cov)) + np.diag(0.05 * spread + 1e-4)
        d = every - own.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(((y == c).sum() + 0.5) / (len(y) + 1)))
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def test_discriminant_against_plain_densities(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    stats = {i: plain_statistics(t) for i, t in texts.items()}
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    train = [i for i in known if not out[i].held_out]
    want = plain_scores(np.array([stats[i] for i in train]), np.array([known[i] for i in train]), np.array([stats[i] for i in texts]))
    assert np.abs(np.array([out[i].score for i in texts]) - want).max() < 1e-3
    assert all(out[i].predicted == (w >= 0.3) for i, w in zip(texts, want, strict=True) if abs(w - 0.3) > 0.01)


def best_fit(sizes, capacity, bins=None):
    """Loads of the bins, item after item."""
    room = [capacity] * bins if bins else []
    for x in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= x
        elif bins:
            room[max(range(bins), key=lambda k: room[k])] -= x
        else:
            room.append(max(capacity, x) - x)
    return sorted(capacity - r for r in room)


def grouped(rows, capacity, piece):
    """Bytes of the groups of equal texts, with those beyond the capacity in pieces by the hash of their ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        each = len(t.encode()) + 16
        if each * len(ids) > capacity:
            n = -(-each * len(ids) // piece)
            out += [c * each for c in Counter(spark_hash(*([i] if i is not None else [])) % n for i in ids).values()]
        else:
            out.append(each * len(ids))
    return out


def test_shards_against_plain_best_fit(spark, docs, rows):
    texts = [r[:2] for r in rows]
    total = sum(len((t or "").encode()) + 16 for _, t in texts)
    for n in (3, 40):
        capacity = -(-total // n)
        loads = Counter()
        for r in sharding.shard(docs, shards=n).collect():
            loads[r.shard] += r.size
        assert sorted([*loads.values(), *[0] * (n - len(loads))]) == best_fit(grouped(texts, capacity, max(1, int(capacity * 0.125))), capacity, n)
    many = [(i, "x" * (i * 7 % 50) + str(i)) for i in range(3000)] + [(5000 + i, "same size " + f"{i:04d}") for i in range(2000)]
    many += [(9000 + i, "equal texts of a large group") for i in range(500)]
    got = sharding.open_shards(spark.createDataFrame(many, "doc_id long, text string"), 1000).collect()
    loads, shards = Counter(), defaultdict(set)
    for r in got:
        loads[r.shard] += r.size
    assert len(got) == len(many) and max(loads.values()) <= 1000
    # Sizes of items are exact here, so that the numbers of shards are the same and the least that best fit gives.
    assert sorted(loads.values()) == best_fit(grouped(many, 1000, 501), 1000)
    assert sharding.open_shards(docs.limit(0), 1000).count() == 0 and not shards


def test_large_sizes_are_packed_exactly(spark, monkeypatch):
    """Sizes beyond 2**16 that differ by single bytes, read and packed a few at a time."""
    monkeypatch.setattr(sharding, "SIZES", 7)
    many = [(i, f"{i:02d}" + "z" * (70_000 + i * 37 % 101)) for i in range(60)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    sizes = [len(t) + 16 for _, t in many]
    for capacity in (2 * max(sizes), sorted(sizes)[30] + sorted(sizes)[29]):
        loads = Counter()
        for r in sharding.open_shards(frame, capacity).collect():
            loads[r.shard] += r.size
        assert sorted(loads.values()) == best_fit(sizes, capacity)
    loads = Counter()
    for r in sharding.shard(frame, shards=9).collect():
        loads[r.shard] += r.size
    assert sorted(loads.values()) == best_fit(sizes, -(-sum(sizes) // 9), 9)


def test_pipeline_on_awkward_rows(spark, docs, rows, tmp_path):
    """Every stage against its plain form, on what the one before kept: nulls, repeated ids, clashing names."""
    labels = [(i, int(i not in (7, 11, 12)), 0) for i in range(20)] + [(100 + i, 1, 0) for i in range(12)] + [(900 + i, i % 2, 0) for i in range(60)]
    junk = [(900 + i, ("!! || $$ ## 12 " * 30 if i % 2 == 0 else f"plain words of number {i} that make a quiet line. " * 8), "en", "s1", 5) + ("?",) * 15 for i in range(60)]
    rows = rows + junk
    item = next(t for i, t, *_ in rows if i == 18).split()
    tables = {
        "documents": spark.createDataFrame(rows, SCHEMA).repartition(3),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, " ".join(item[20:50])), (2, None), (3, "one")], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    bag = lambda df: Counter(tuple(r) for r in df.collect())
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path)).cache()
        before = [tuple(r) for r in now.collect()]
        if k < 4:
            assert after.columns == now.columns
        if k == 0:
            train = [(i, q) for i, q, _ in labels if zlib_crc(i) % 5]
            stats = {r[0]: plain_statistics(r[1] or "") for r in before if r[0] is not None}
            fit = [(stats_of, q) for i, q in train for stats_of in [plain_statistics(r[1] or "") for r in before if r[0] == i]]
            x, y = np.array([f for f, _ in fit]), np.array([q for _, q in fit])
            scores = plain_scores(x, y, np.array([plain_statistics(r[1] or "") for r in before]))
            assert bag(after) == Counter(r for r, s in zip(before, scores, strict=True) if s >= 0.3)
            assert stats and not any((r.doc_id or 0) >= 900 and r.doc_id % 2 == 0 for r in after.collect())
        elif k == 1:
            assert bag(after) == plain_dedup(before)
        elif k == 2:
            dirty = Counter()
            for i, _, n_hit, _, bad in contamination([r[:2] for r in before], [(1, " ".join(item[20:50])), (3, "one")]):
                dirty[i] += bad
            assert bag(after) == Counter(r for r in before if not dirty[r[0]])
            assert after.where("doc_id = 18").count() == 0
        elif k == 3:
            words = Counter()
            for r in after.collect():
                words[r.doc_id] += len(WORDS.findall(r.text or ""))
            want = Counter()
            for (i, _, taken), n in plain_mix(sized(before)).items():
                want[i] += taken * n
            assert +words == +want and set(after.columns) == set(now.columns)
        else:
            assert sorted(loads_of(after)) == [x for x in best_fit(grouped([r[:2] for r in before], *capacities(before)), capacities(before)[0], 40) if x]
            assert after.count() == len(before)
        kept.append(after.count())
        now = after
    assert kept[0] > kept[1] > kept[2] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1]
    # Nothing in, nothing out.
    (tmp_path / "none").mkdir()
    for name in tables:
        tables[name].limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def zlib_crc(i) -> int:
    import zlib

    return zlib.crc32(str(i).encode())


def capacities(rows, shards=40):
    capacity = max(1, -(-sum(len((r[1] or "").encode()) + 16 for r in rows) // shards))
    return capacity, max(1, int(capacity * 0.125))


def loads_of(df):
    out = Counter()
    for r in df.collect():
        out[r.shard] += r.size
    return out.values()


def plain_dedup(rows) -> Counter:
    """One of each class by all pairs; of rows with one id, each different text of a kept id."""
    texts = dict(enumerate(r[1] for r in rows))
    bags = weighted_bags(texts)
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    total = {i: sum(b.values()) for i, b in bags.items()}
    for i in texts:
        for j in range(i):
            if bags[i] and bags[j] and rows[i][0] is not None and rows[j][0] is not None:
                shared = sum(min(v, bags[j][k]) for k, v in bags[i].items() if k in bags[j])
                if shared >= 0.8 * (total[i] + total[j] - shared):
                    label[max(find(i), find(j))] = min(find(i), find(j))
    classes = defaultdict(set)
    for i in texts:
        classes[find(i)].add(rows[i][0])
    ids = {min(c) for c in classes.values() if None not in c}
    out = Counter()
    for r in rows:
        if r[0] is None:
            out[r] += 1
        elif r[0] in ids and not any(x[0] == r[0] and x[1] == r[1] for x in out):
            out[r] += 1
    return out


TEXT_OPERATORS = {
    "op1": lambda d, b, y: suffix_dedup.dedup(d), "op2": lambda d, b, y: pii.scan(d), "op3": lambda d, b, y: mixing.mix(d).taken(),
    "op5": lambda d, b, y: sharding.shard(d), "op6": lambda d, b, y: minhash.near_duplicates(d), "op7": lambda d, b, y: passages.dedup(d),
    "op8": lambda d, b, y: licenses.scan(d), "op9": lambda d, b, y: decontamination.decontaminate(d, b), "op10": lambda d, b, y: quality.classify(d, y),
}
LONG_IDS = ("op1", "op6", "op7")


@pytest.mark.parametrize("name", sorted(TEXT_OPERATORS))
def test_very_long_texts_and_other_ids(spark, name):
    """A text of 10 MB beside small ones is worked out whole; int ids work, and text ids do or are refused."""
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(50_000)])
    long = " ".join(rng.choice(words, 1_800_000))
    assert len(long) > 10_000_000
    passage = " ".join(long.split()[1_700_000:1_700_060])
    rows = [(1, long, "a"), (2, passage, "a"), (3, "mail x@y.org under the mit license", "b"), (4, None, None)]
    benchmark = spark.createDataFrame([(1, passage)], "item_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id int, quality int")
    run = TEXT_OPERATORS[name]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in run(df, benchmark, labels).collect()}
    assert set(got) == {1, 2, 3, 4}
    n_words, n_bytes = 1_800_000, len(long)
    if name == "op1":
        assert got[1].n_bytes == n_bytes and got[1].n_removed == 0 and got[2].n_removed == len(passage)
    elif name == "op2":
        assert got[3].n_email == 1 and got[1].base_spans == ""
    elif name == "op3":
        assert got[1].size == n_words and abs(got[1].taken + got[2].taken - got[1].target) <= 128
    elif name == "op5":
        assert got[1].size == n_bytes + 16
    elif name == "op6":
        assert all(got[i].class_id == i for i in got)
    elif name == "op7":
        assert got[1].n_words == n_words and got[2].n_removed == 60
    elif name == "op8":
        assert got[1].n_words == n_words and got[3].base_labels == "mit"
    elif name == "op9":
        assert (got[1].n_words, got[1].n_hit, got[1].contaminated, got[2].contaminated) == (n_words, 60, False, True)
    else:
        assert 0 <= got[1].score <= 1
    text_ids = spark.createDataFrame([(f"d{i}", t, s) for i, t, s in rows[1:]], "doc_id string, text string, source string")
    if name in LONG_IDS:
        with pytest.raises(TypeError, match="doc_id is string"):
            run(text_ids, benchmark, labels)
    else:
        labels = labels.selectExpr("concat('d', doc_id) as doc_id", "quality")
        assert {r.doc_id for r in run(text_ids, benchmark, labels).collect()} == {"d2", "d3", "d4"}


def test_ids_of_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}
    with pytest.raises(TypeError, match="vec_id is string"):
        embeddings.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace as Some

    from parcelspark.sources.shared import shared_dir

    session = lambda master, path: Some(conf=Some(get=lambda k, d: path), sparkContext=Some(master=master))
    assert shared_dir(session("yarn", "hdfs:///x/")) == "hdfs:///x" and shared_dir(session("local[4]", None)).startswith("file:")
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))


