"""Each operator against a brute-force version, on the small tables and on odd rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneflow.llm import (
    bwt_dedup,
    byte_bpe,
    external_shuffle,
    improbable_digest,
    line_dedup,
    packing,
    prob_minhash,
    quality_ledger,
    skip_chain_crf,
)

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")

DIGESTS = {
    "op1": line_dedup.digest, "op2": improbable_digest.digest, "op3": quality_ledger.digest,
    "op4": lambda d: packing.packed(d, WORDS), "op5": external_shuffle.digest,
    "op6": lambda d: byte_bpe.digest(d, RANKS, P.PATTERN), "op8": bwt_dedup.digest,
    "op9": prob_minhash.digest, "op10": skip_chain_crf.digest,
}


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("op", DIGESTS)
def test_empty_table(op, no_docs):
    assert DIGESTS[op](no_docs).collect() == []


@pytest.mark.parametrize("op", [x for x in DIGESTS if x != "op4"])
def test_one_row_per_input_row(op, odd_docs):
    out = DIGESTS[op](odd_docs).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, _ in pairs(odd_docs))


# -- op1
def brute_lines(rows):
    docs = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        if i is not None:
            for x in t.split("\n"):
                if len(key(x)) >= 40:
                    docs[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if i is None or len(docs.get(key(x), ())) < 5 or max(docs[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def test_line_dedup(spark):
    line = "This Line is Repeated in Many Documents, over and over É"
    rows = [(i, f"own line of document {i}\n  {line.upper() if i % 2 else line}\t\n{line}\nend") for i in range(7)]
    rows += [(6, rows[6][1]), (9, None), (10, ""), (11, line.replace("É", "é")), (None, line), (12, "\n\n" + line + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in line_dedup.digest(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == brute_lines([(i, t or "") for i, t in rows])


def test_line_dedup_keeps_columns(odd_docs):
    out = line_dedup.drop_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


# -- op2
def test_entropies_and_votes():
    t = np.frombuffer(b"abracadabra " * 40 + bytes(range(200)), np.uint8)
    e = improbable_digest.entropies(t)
    for i in (0, 1, 77, 400, len(t) - 64):
        total = sum(int(improbable_digest._GAIN[c]) for c in np.unique(t[i:i + 64], return_counts=True)[1])
        assert e[i] == 1000 * (improbable_digest._FULL - total) // improbable_digest._FULL
    counts = improbable_digest.count_entropies([b"x" * 100, b"", t.tobytes()])
    assert counts.sum() == sum(len(x) + 48 - 63 for x in (b"x" * 100, t.tobytes()))


def plain_entropies(t):
    gain = lambda w: sum(int(improbable_digest._GAIN[c]) for c in collections.Counter(w).values())
    full = improbable_digest._FULL
    return [1000 * (full - gain(t[i:i + 64])) // full for i in range(len(t) - 63)]


@pytest.mark.parametrize("rest", range(65))
def test_entropies_at_every_remainder_of_a_block(rest, monkeypatch):
    monkeypatch.setattr(improbable_digest, "KERNEL", 128)
    raw = bytes(np.random.default_rng(rest).integers(97, 109, 256 + rest, dtype=np.uint8))
    assert improbable_digest.entropies(np.frombuffer(raw, np.uint8)).tolist() == plain_entropies(raw)


def plain_digest(text, ranks):
    """Filters of one text, each (set of bits, features), by the module's docstring."""
    if not text:
        return []
    raw = (improbable_digest.LEAD + text).ljust(64, b"\0")
    order = [(int(ranks[e]), i) for i, e in enumerate(plain_entropies(raw))]
    votes = collections.Counter(min(order[a:a + 64])[1] for a in range(len(order)))
    need = min(improbable_digest.POPULAR, max(votes.values()))
    feats = [raw[i:i + 64] for i in sorted(votes) if votes[i] >= need]
    out = []
    for a in range(0, len(feats), improbable_digest.PER_FILTER):
        bits = set()
        for f in feats[a:a + improbable_digest.PER_FILTER]:
            h = 0x243F6A8885A308D3
            for k in range(0, 64, 8):
                h = (h ^ int.from_bytes(f[k:k + 8], "little")) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            bits |= {(h >> 11 * k) % 2048 for k in range(improbable_digest.HASHES)}
        out.append((bits, len(feats[a:a + improbable_digest.PER_FILTER])))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    def score(x, y):
        most, chance = min(len(x), len(y)), len(x) * len(y) / 2048
        low = improbable_digest.ALPHA * (most - chance) + chance
        return min(1, max(0, (len(x & y) - low) / max(most - low, 1e-9)))
    side = lambda p, q: sum(n * max(score(x, y) for y, _ in q) for x, n in p) / sum(n for _, n in p)
    if len(a) != len(b):
        return side(*sorted((a, b), key=len))
    return (side(a, b) + side(b, a)) / 2


def test_digests_and_likeness_by_brute_force(docs_sf):
    texts = [t.encode() for _, t in sorted(pairs(docs_sf), key=lambda x: (len(x[1]), x[1]))]
    middle = [t for t in texts if 1000 < len(t) < 4000]
    long = [b"\n".join(middle[k:k + 12]) for k in (0, 6)]
    texts = [b"", b"ab", *[t for t in texts if 100 < len(t) < 4000][:14], *long]
    texts += [texts[6][:-80] + texts[7][:80], long[0][:15_000]]
    ranks = improbable_digest.rank_table(improbable_digest.count_entropies(texts))
    got, plain = improbable_digest.digests(texts, ranks), [plain_digest(t, ranks) for t in texts]
    assert max(map(len, plain)) > 1
    for d, p in zip(got, plain, strict=True):
        bits = [set(np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little")).tolist()) for row in d.bits]
        assert list(zip(bits, d.features.tolist(), strict=True)) == p
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert improbable_digest.likeness(got[i], got[j]) == pytest.approx(plain_likeness(plain[i], plain[j]))


def test_fingerprints(spark, docs_sf):
    rows = sorted(pairs(docs_sf))
    out = {r["doc_id"]: r for r in improbable_digest.digest(docs_sf).collect()}
    near, nxt = [], []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 4
        assert out[i]["n_chars"] == len(t)
        assert out[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - k] + u[:k]).encode()).hexdigest()
        assert 0 <= out[i]["near_next"] <= 1
        near.append(out[i]["near_edited"])
        nxt.append(out[i]["near_next"])
    assert np.median(near) > 0.5 and np.median(nxt) < 0.05
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t].add(out[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_ranges_do_not_change_successors(spark):
    rows = [(i * 3, f"text number {i} " * (i % 7 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "5", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r["doc_id"], r["edited_sha256"]) for r in improbable_digest.digest(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]


# -- op3
def test_ablations_and_policy(spark, docs_sf):
    led = quality_ledger.ledger(docs_sf).cache()
    bits = [r["failed_bits"] for r in led.collect()]
    m = quality_ledger.mask("v1")
    names = [n for n, _ in quality_ledger.rules()]
    got = {r["rule"]: (r["rejected"], r["only_by_it"]) for r in quality_ledger.ablations(led).collect()}
    for i, n in enumerate(names):
        if m >> i & 1:
            assert got[n] == (sum(b >> i & 1 for b in bits), sum((b & m) == 1 << i for b in bits))
    kept = quality_ledger.keep_passing(docs_sf)
    assert kept.columns == docs_sf.columns
    assert kept.count() == sum(b & m == 0 for b in bits)


def test_repeat_words(spark):
    texts = ["a b c d e f g h " * 3, "a b c d e f g h x a b c d e f g h", "one two three", "q " * 30, "a b c d e f g h a b c d e f g"]
    out = quality_ledger.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in out.collect():
        w = texts[r["doc_id"]].split()
        grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert r["n_repeat_words"] == len(hit)


# -- op4
def test_packing(docs_sf, odd_docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    for df in (docs_sf, odd_docs):
        rows = pairs(df)
        ids = collections.defaultdict(list)
        for i, t in rows:
            ids[i].append([*tok.encode(t, add_special_tokens=False).ids, 2])
        used = collections.defaultdict(list)
        pieces = collections.Counter()
        for r in packing.packed(df, WORDS).collect():
            used[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]] += r["length"]
            assert any(zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
                       and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        assert pieces == {i: sum(map(len, x)) for i, x in ids.items()}
        for spans in used.values():
            at = 0
            for o, n in sorted(spans):
                assert o == at
                at += n
            assert at <= 4096
        total = sum(pieces.values())
        assert len(used) <= -(-total // 4096) + max(2, total // 4096 // 20)


def test_added_tokens_in_texts(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    texts = ["end <|endoftext|> here", "<|startoftext|>A b", "x<|endoftext|>\n<|endoftext|>", "End <|EndOfText|> here", "<|endoftext| > plain", "Plain words", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert 49407 in want[0]
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.packed(df, WORDS).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_best_fit_takes_the_tightest_window():
    where, offset = packing.best_fit_decreasing(np.array([60, 50, 40, 45, 5, 100]), 100)
    assert where.tolist() == [1, 2, 1, 2, 2, 0] and offset.tolist() == [0, 0, 60, 50, 95, 0]


def test_sequences(docs_sf):
    placed = packing.packed(docs_sf, WORDS).cache()
    sizes = {r["sequence_id"]: r["n"] for r in placed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    assert {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(docs_sf, placed, WORDS).collect()} == sizes


# -- op5
def test_shards(docs_sf, odd_docs):
    for df in (docs_sf, odd_docs):
        out = external_shuffle.digest(df).collect()
        sizes = collections.Counter(r["shard"] for r in out)
        assert max(sizes.values()) - min([sizes.get(k, 0) for k in range(24)]) <= 1
        for k in sizes:
            assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))
        want = collections.Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in pairs(df))
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        assert sorted(map(tuple, external_shuffle.digest(df).select("doc_id", "shard", "slot").collect()), key=str) == \
            sorted(((r["doc_id"], r["shard"], r["slot"]) for r in out), key=str)


def test_the_registered_query_moves_whole_records(docs_sf, odd_docs):
    """sizes and checksums were taken first, and only they went through the shuffle."""
    def moved(node):
        below = [x for k in range(node.children().size()) for x in moved(node.children().apply(k))]
        return [node.schema().simpleString(), *below] if node.nodeName().startswith("Repartition") else below

    for df in (docs_sf, odd_docs):
        records = moved(external_shuffle.digest(df)._jdf.queryExecution().optimizedPlan())
        assert len(records) == 1 and all(f"{f.name}:{f.dataType.simpleString()}" in records[0] for f in df.schema if f.name not in ("bucket", "shard", "slot", "rank"))


def test_write_shards(spark, docs_sf, tmp_path):
    external_shuffle.write_shards(docs_sf, str(tmp_path / "s"), shards=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["text"] for r in back.collect()) == sorted(t for _, t in pairs(docs_sf))


def test_equal_records_fill_all_buckets(spark):
    """A record that all rows repeat is scattered like different ones."""
    same = spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text")
    placed, n, buckets = external_shuffle._placed(same, 500, 1 << 30)
    assert (n, buckets) == (20_000, 40)
    held = placed.select(F.pmod(F.xxhash64(F.lit(1), "place"), F.lit(40)).alias("b")).groupBy("b").count().collect()
    assert len(held) == 40 and max(r["count"] for r in held) < 1_000
    out = external_shuffle.assign(same, bucket_rows=500).groupBy("shard").agg(F.count("*"), F.countDistinct("slot"), F.max("slot")).collect()
    assert all(a == b == c + 1 for _, a, b, c in out) and sum(r[1] for r in out) == 20_000


def test_buckets_follow_bytes(spark):
    """Long texts, arrays and maps make more buckets of fewer rows."""
    df = spark.range(400).selectExpr("id", "repeat('x', 10000) AS text", "array(id, id) AS a", "map('k', id) AS m", "CAST(NULL AS STRING) AS z")
    assert external_shuffle._placed(df, 50_000, 100_000)[2] >= 40
    out = external_shuffle.assign(df, shards=7, bucket_bytes=100_000)
    assert sorted(r["id"] for r in out.select("id").collect()) == list(range(400))


def test_written_shards_read_back_in_slot_order(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    external_shuffle.write_shards(spark.range(5_000).selectExpr("id AS doc_id"), str(tmp_path / "s"), shards=3, bucket_rows=200)
    for k in range(3):
        files = sorted(glob.glob(f"{tmp_path}/s/shard={k}/*.parquet"))
        slots = [x for f in files for x in pq.ParquetFile(f).read(columns=["slot"]).column(0).to_pylist()]
        assert len(files) > 1 and slots == list(range(len(slots))) and len(slots) in (1666, 1667)


# -- op6
def test_byte_bpe(docs_sf, odd_docs):
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs_sf, odd_docs):
        want = collections.Counter()
        for i, t in pairs(df):
            ids = enc.encode_ordinary(t)
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, byte_bpe.digest(df, RANKS, P.PATTERN).collect())) == want
    both = byte_bpe.decode(byte_bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both.collect())


def test_long_pieces_take_the_heap():
    import tiktoken
    with open(RANKS, "rb") as f:
        c = byte_bpe.Codec(f.read(), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t in ("ab" * 900, "thequickbrown" * 100, " " * 2000, "é" * 700, "\x00\x01" * 600):
        assert c.encode_block([t])[0].tolist() == enc.encode_ordinary(t)


# -- op8
def brute_strings(rows):
    seen = collections.Counter()
    raws = [(i, t.encode()) for i, t in rows]
    for _, r in raws:
        for k in range(len(r) - 399):
            seen[r[k:k + 400]] += 1
    out = collections.Counter()
    for i, r in raws:
        runs = []
        for k in range(len(r) - 399):
            if seen[r[k:k + 400]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + 400
                else:
                    runs.append([k, k + 400])
        out[(i, len(r), sum(b - a for a, b in runs), len(runs), hashlib.sha256(bwt_dedup.cut(r, runs)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limit", [2000, 2])
def test_repeated_strings(spark, monkeypatch, limit):
    from .conftest import prose
    monkeypatch.setattr(bwt_dedup, "GROUP_ROWS", limit)  # 2: every group is cut down to single windows
    p, q = prose(5, 90), prose(6, 300)
    rows = [(1, prose(7, 40) + p + prose(8, 30)), (2, p + q), (3, q[100:900] + prose(9, 50)), (4, prose(7, 40) + p[:399]), (5, "ab" * 600),
            (6, q[:500] + "é" + q[500:]), (7, prose(10, 30) + p[13:] + q[20:]), (8, None), (9, ""), (10, prose(11, 300)), (10, prose(11, 300)),
            (None, prose(12, 200)), *((20 + i, prose(30 + i, 20) + p[:380] + prose(60 + i, 20)) for i in range(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, bwt_dedup.digest(df).collect()))
    assert got == brute_strings([(i, t or "") for i, t in rows])
    kept = bwt_dedup.remove(df)
    assert kept.columns == ["doc_id", "text", "kept"]


# -- op9
def test_sketch_estimates_probability_jaccard():
    base = [f"t{i * i % 311}" for i in range(400)]
    a = base + base[:50] * 3
    b = a[:200] + ["new"] * 3 + a[203:]
    est = []
    for z in range(30):
        s = prob_minhash.shingles(pa.array([" ".join(f"{w}_{z}" for w in x) for x in (a, b)]))
        r = prob_minhash.sketch(*s, 2)
        est.append((r[0] == r[1]).mean())
    x, y = (collections.Counter(tuple(t[i:i + 5]) for i in range(len(t) - 4)) for t in (a, b))
    true = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    assert abs(np.mean(est) - true) < 0.02
    doc, sh = prob_minhash.shingles(pa.array([" ".join(a), " ".join(b)]))
    low = (sh >> np.uint64(20)).astype(np.uint32)
    p, q = low[doc == 0], low[doc == 1]
    jac = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    assert prob_minhash.similar(p, q, max(true, jac) - 0.002) and not prob_minhash.similar(p, q, max(true, jac) + 0.002)


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bags[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in bags}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    text = dict(rows)
    ids = sorted(bags)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            u = len(bags[i] | bags[j])
            if text[i] == text[j] or u and len(bags[i] & bags[j]) >= 0.8 * u:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in bags}


def test_similar_texts_share_a_prefix_shingle():
    """Exact at the bound, whatever the order: plain and weighted, and with equal counters."""
    r = np.random.default_rng(11)
    hits = 0
    for turn in range(400):
        a = r.integers(0, 60, r.integers(5, 60)).astype(np.uint32)
        if turn % 2:
            a = np.unique(a)
        b = np.where(r.random(len(a)) < 0.1, r.integers(0, 80, len(a)).astype(np.uint32), a)
        b = np.unique(b) if turn % 2 else np.sort(np.concatenate([b, np.repeat(b[:1], r.integers(0, 6))]))
        a = np.sort(a)
        counts = r.integers(0, 1 if turn % 4 == 0 else 9, prob_minhash.COUNTERS)
        if prob_minhash.similar(a, b):
            hits += 1
            p, q = (prob_minhash.prefix_of(x, counts).tolist() for x in (a, b))
            both = [x for x in p if x in q]
            assert both
            if len(set(a)) == len(a) and len(set(b)) == len(b):  # the bound on places holds for the first one
                common = int(np.ceil((len(a) + len(b)) * 0.8 / 1.8 - 1e-6))
                assert p.index(both[0]) <= len(a) - common and q.index(both[0]) <= len(b) - common
    assert hits > 30


def test_classes(spark, docs_sf):
    from .conftest import prose
    base = prose(3, 200).split()
    rows = pairs(docs_sf)
    # a star (copies of one text that differ from each other) and a chain
    for k in range(12):
        w = list(base)
        w[15 * k + 3] = "zz"
        w[15 * k + 7] = "yy"
        rows.append((5000 + k, " ".join(w)))
    chain = list(base[:150])
    for k in range(8):
        rows.append((6000 + k, " ".join(chain)))
        chain[k * 18] = f"c{k}"
        chain[k * 18 + 9] = f"d{k}"
    rows += [(7000, ""), (7001, "  "), (7002, "a b"), (7003, "a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.digest(df).collect()}
    assert got == brute_classes(rows)


def test_pairs_with_unequal_repeats(spark):
    from .conftest import prose
    rows = []
    for k in range(24):  # Jaccard similarity 0.8 or more, the tail of one copy many times
        words = prose(900 + k, 60).split()
        tail, times = (words[-15:], 10) if k % 2 else (words[-8:], 20)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + tail * (times - 1)))]
    other = prose(950, 60).split()  # both repeat, unequally
    rows += [(100, " ".join(other + other[:12] * 9)), (101, " ".join(other + other[:12] * 2))]
    want = brute_classes(rows)
    assert sum(i != c for i, c in want.items()) >= 20
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_keep_one(odd_docs):
    out = prob_minhash.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert 5 in ids and 6 not in ids and 11 not in ids and ids.count(7) == 1 and None in ids


def test_keep_one_keeps_both_texts_of_an_id(spark):
    from .conftest import prose
    a, b = prose(971, 80), prose(972, 80)
    rows = [(7, a), (7, b), (7, b), (7, a + " end"), (8, b), (9, prose(973, 80))]
    out = prob_minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = [r["text"] for r in out if r["text"] in (a, a + " end")]
    assert len(near) == 1 and sorted((r["doc_id"], r["text"]) for r in out) == sorted([(7, near[0]), (7, b), rows[-1]])


# -- op10
PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_personal(t):
    out = []
    for kind, (_, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (16 <= len(d) <= 19 and skip_chain_crf.luhn(d)) \
                    or kind == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns():
    import random
    r = random.Random(4)
    for alphabet in ("12345.. -@a+(())\n%", "0123456789- ", "a.@b-@.", "0.1.2.3"):
        for _ in range(1500):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 70)))
            assert skip_chain_crf.base_spans(t) == brute_personal(t)


def test_personal_data(docs_sf):
    text = dict(pairs(docs_sf))
    for r in skip_chain_crf.digest(docs_sf).collect():
        base = brute_personal(text[r["doc_id"]])
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(x[0] == i for x in base) for i in range(4)]
        line = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


def test_field_learns_and_repetition_pulls():
    texts = [f"mail me at user{i}.{i}@mail{i % 9}.example.com or call +1 ({200 + i}) 555-{1000 + i} in room {i}" for i in range(150)]
    f, links, y = [], [], []
    for t in texts:
        s = skip_chain_crf.tokens(t)
        links += [(k, i + len(y), j + len(y)) for k, i, j in skip_chain_crf.edges(t, s)]
        f += skip_chain_crf.node_features(t, s)
        y += skip_chain_crf.label_tokens(s, skip_chain_crf.base_spans(t))
    field = skip_chain_crf.fit_field(f, links, np.array(y))
    held = "room 77 and (555) 555-4444 there"
    (base, every), = skip_chain_crf.all_spans([held], field)
    assert not base and any(k == 3 for k, _, _ in every)
    score = np.zeros((2, 5))
    score[0, 4] = 4.0
    alone = skip_chain_crf.Field(np.vstack([score, np.zeros((2, 5))]), field.pair)
    linked = alone.marginals([[0], [1]], [(1, 0, 1)])
    apart = alone.marginals([[0], [1]], [])
    assert linked[1, 4] > apart[1, 4] + 0.2


def test_redact(odd_docs, spark):
    field = skip_chain_crf.fit_field([], [], np.empty(0, np.int64))
    df = spark.createDataFrame([(1, "a b@c.de f 1.2.3.4"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in skip_chain_crf.redact(df, field).orderBy("doc_id").collect()] == ["a <EMAIL> f <IP>", None]
    assert skip_chain_crf.redact(odd_docs, field).columns == odd_docs.columns
    assert skip_chain_crf.find(odd_docs, field).columns == [*[c for c in odd_docs.columns if c != "spans"], "spans"]
