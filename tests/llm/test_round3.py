"""Token files, filter audit and conversation repair against brute-force versions."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from paneflow.llm import byte_chunks, byte_transducer, path_ranking, range_ans

BYTES = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


# -- op11
def plain_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTES)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for t in texts]


def check_files(df, out):
    rows = df.select("doc_id", "text").collect()
    ids = plain_ids([r["text"] for r in rows])
    want = collections.Counter((r["doc_id"], len(x), zlib.crc32(x.astype("<u4"))) for r, x in zip(rows, ids, strict=True))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()))
    assert collections.Counter(r[1:] for r in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    order = [r[1] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_token_files(docs_sf):
    check_files(docs_sf, range_ans.digest(docs_sf, BYTES))


def test_token_files_of_odd_rows(odd_docs, no_docs):
    check_files(odd_docs, range_ans.digest(odd_docs, BYTES))
    assert range_ans.digest(no_docs, BYTES).collect() == []


def test_ids_come_back(spark, odd_docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    range_ans.write(range_ans.token_ids(odd_docs, BYTES), folder, files=3)
    texts = collections.defaultdict(list)
    for r in sorted(range_ans.read(spark, folder).collect(), key=lambda r: (r["start"], r["piece"])):
        texts[r["start"]] += r["ids"]
    want = collections.Counter(tuple(x.tolist()) for x in plain_ids([r["text"] for r in odd_docs.collect()]))
    assert collections.Counter(map(tuple, texts.values())) == want


def test_blocks_and_checkpoints(monkeypatch):
    rng = np.random.default_rng(5)
    for kinds, n in ((1, 100), (3, 31), (300, range_ans.BLOCK_IDS), (40_000, 70_000), (50_257, 33)):
        ids = (rng.integers(0, kinds, n) * rng.random(n) ** 3).astype(np.uint32)
        used, counts = np.unique(ids, return_counts=True)
        table = range_ans.Table.of_counts(used.tolist(), counts.tolist())
        assert table.freq.sum() == 1 << range_ans.PRECISION and (table.freq[used] > 0).all()
        raw = [range_ans.pack_block(part, [(7, True, 0, n), (0, False, 3, 1)], range_ans.encode(part[None, :], table)[0])
               for part in np.split(ids, range(range_ans.BLOCK_IDS, n, range_ans.BLOCK_IDS))]
        group = [range_ans.Block(x) for x in raw]
        assert (np.concatenate(range_ans.open_blocks(group, table)) == ids).all()
        assert group[0].docs == [(7, 0, n), (None, 3, 1)]
        # a segment opens from its checkpoint alone
        b = group[0]
        k = len(b.states) - 1
        got = range_ans.decode(b.states[k:], b.offsets[k:], np.append(b.words, np.uint32(0)), b.n - k * range_ans.SEGMENT_IDS, table)[0]
        assert (got[0] == ids[k * range_ans.SEGMENT_IDS:b.n]).all()
        bad = bytearray(raw[0])
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError):
            range_ans.Block(bytes(bad))
    # close to the entropy
    p = counts / counts.sum()
    assert n < 1000 or len(raw[0]) * 8 < 1.1 * n * -(p * np.log2(p)).sum() + 8 * 4096


def odd_text(r, n):
    return "".join(r.choice(["a", "Be", "é", " ", "  ", "\n", "\n\n", ",", ".", "'s", "1", "日本", *ODD[r.randrange(4)]]) for _ in range(n))


ODD = (["\t", "\r\n", "\x0b"], ["<|endoftext|>", "\0"], ["\x1c", "\xa0", "\u2003", "\u180e", "\u200b"], ["word", "Word"])


def test_long_texts_in_pieces():
    r = random.Random(3)
    text = odd_text(r, 3000)
    for size in (1, 7, 50):
        parts = list(byte_chunks.pieces_of(text, size))
        assert "".join(parts) == text and len(parts) > 3
        ids = plain_ids(parts)
        assert np.concatenate([x[:-1] for x in ids]).tolist() == plain_ids([text])[0][:-1].tolist()


def test_chunks_give_the_ids_of_whole_texts(docs_sf):
    r = random.Random(8)
    plain = ["a", "Be", "é", " ", " ", "  ", "\n", "\n\n", ",", ".", "'s", "1", "日本", "word", "Word"]
    texts = ["", " ", "\n", "\n\n", "  ", "a ", " a", "a\n", "a  ", "\n a", *("".join(r.choice(plain) for _ in range(r.randint(1, 40))) for _ in range(3000))]
    texts += [odd_text(r, r.randint(1, 30)) for _ in range(1000)] + [x["text"] for x in docs_sf.collect()]
    enc = byte_chunks.ByteChunks(BYTES)
    for part in (texts, texts[:500]):
        got = enc.encode(pa.array([*part, None]))
        assert [x.tolist() for x in got] == [x[:-1].tolist() for x in plain_ids([*part, ""])]


def test_long_documents_stream(spark, monkeypatch):
    monkeypatch.setattr(range_ans, "RUN_BLOCKS", 1)
    long = " ".join(f"word{i * 7919 % 1000}" for i in range(120_000))
    df = spark.createDataFrame([(1, "first"), (2, long), (3, "after it"), (4, None)], "doc_id long, text string")
    check_files(df, range_ans.digest(df, BYTES))


# -- op12
def plain_numbers(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(w), len(set(w)), len(text), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text))]


def odd_texts():
    r = random.Random(9)
    alphabet = ["a", "b", "A", "É", "日", "#", "|", " ", "\n", "\t", "\x0b", "\xa0", " ", "word", "x" * 70, "x" * 70 + "y", "𝔘"]
    return ["", " ", "\n\n", "a", *("".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(200))]


def test_transducer_numbers(monkeypatch):
    texts = odd_texts()
    want = [plain_numbers(t) for t in texts]
    assert byte_transducer.read_texts([t.encode() for t in texts]).T.tolist() == want
    monkeypatch.setattr(byte_transducer, "PIECE", 64)
    assert byte_transducer.read_texts([t.encode() for t in texts]).T.tolist() == want


def test_words_of_one_hash_are_verified(monkeypatch):
    texts = odd_texts()
    monkeypatch.setattr(byte_transducer.Words, "_hashes", lambda self: np.full(len(self.begin), 3, np.uint64))
    got = byte_transducer.read_texts([t.encode() for t in texts[:40]])
    assert got.T.tolist() == [plain_numbers(t) for t in texts[:40]]


def plain_audit(docs, labels):
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, lang, t in docs:
        w, d, n, c, s = plain_numbers(t or "")
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 3 * n, "D": s > 0, "E": i is not None and first[t or ""] < i}
        rows.append((lang or "", fails, i in good, i in toxic))
    out, share = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, fails, g, x in rows:
            before = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, order, step), collections.Counter())
                now = fails[f]
                c["kept"] += not before and not now
                c["removed"] += now and not before
                c["redundant"] += now and before
                c["unique_fails"] += now and sum(fails.values()) == 1
                c["good_lost"] += now and not before and g
                c["toxic_lost"] += now and not before and x
                share[part, f] += now and not before
                before |= now
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*k, *(c[x] for x in names), share[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit(spark, odd_docs, no_docs):
    r = random.Random(2)
    texts = ["word " * 300, "A B C D " * 60, "a" * 30, " ".join(f"w{i}" for i in range(250)), "#tag " + " ".join(f"v{i}" for i in range(250)), None, ""]
    docs = [(i if i % 17 else None, r.choice(["en", "de", None, ""]), r.choice(texts)) for i in range(150)]
    docs += docs[:10]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id long, lang string, text string, part string, bits string, n string")
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
           for r in byte_transducer.audit(df, ldf).collect()}
    assert got == plain_audit(docs, labels)
    odd = byte_transducer.audit(odd_docs.withColumn("lang", odd_docs["row"]), ldf.limit(0))
    assert odd.count() == 600 and odd.agg({"kept": "max"}).first()[0] <= odd_docs.count()
    assert byte_transducer.audit(no_docs.withColumn("lang", no_docs["row"]), ldf).collect() == []


# -- op13
FAR = (10**9, "", ())


def plain_repair(rows):
    """(cost, audit, repaired rows) by exhaustive recursion; rows: (role, text, fault)."""
    ok = {0: ("s", "u"), 1: ("u",), 2: ("a",), 3: ("u",)}

    def step(state, initial):
        return 1 if initial == "s" else {"u": 2, "a": 3}[initial]

    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = []

        def put(price, letter, rest, row):
            found.append((price + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in ok[state]:
                    put(2, "I", best(i, step(state, role[0]), inserted + 1), (role, ""))
        if i < len(rows):
            role, text, fault = rows[i]
            extra = fault == "truncated"
            put(3, "D", best(i + 1, state, 0), None)
            if fault not in ("blank", "duplicate"):
                if role[:1] in ok[state]:
                    put(extra, "K", best(i + 1, step(state, role[:1]), 0), (role, text))
                for new in ("user", "assistant"):
                    if new[0] in ok[state]:
                        put(2 + extra, "R", best(i + 1, step(state, new[0]), 0), (new, text))
        return min(found, key=lambda x: x[:2], default=FAR)

    return best(0, 0, 0)


def plain_conversations(rows):
    out, groups = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        same = hashlib.sha256(f"{' ' if conv is None else conv}:{len(role)}:{role}{text}".encode()).hexdigest()
        for copy in range(1 + (k == 3)):
            groups[conv].append((turn is not None, turn or 0, role, same, copy, turn, text))
    for conv, g in groups.items():
        g.sort(key=lambda r: r[:5])
        seen, marked, n = set(), [], collections.Counter()
        for *_, role, _, _, _, text in ((r[2], r[3], r[4], r[5], r[6]) for r in g):
            plain = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            n[fault] += 1
        n["illegal"] = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        turns = {r[5] for r in g} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, kept = plain_repair(tuple(marked)) if marked else (0, "", ())
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in path_ranking.digest(df).collect()}


def test_least_audits():
    r = random.Random(1)
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    faults = [None, "blank", "duplicate", "truncated"]
    for _ in range(1500):
        initials = "".join(r.choice("suuaaax") for _ in range(r.randint(1, 9)))
        marks = [r.choice([0, 0, 0, 1, 2, 3]) for _ in initials]
        cost, audit, _ = plain_repair(tuple((roles[x], "t", faults[m]) for x, m in zip(initials, marks, strict=True)))
        assert path_ranking.audit_of(initials, marks) == (cost, audit), (initials, marks)


def test_repair_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert repaired(df) == plain_conversations([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def odd_conversations():
    r = random.Random(4)
    texts = ["Yes.", "No", "", " ", "\n", None, "Why?", "é!", "long " * 2000 + "."]
    rows = [(r.choice([None, *range(12)]), r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts))
            for _ in range(160)]
    return rows + rows[:20] + [(77, t, "user" if t % 3 else "assistant", f"line {t % 50}.") for t in range(90)]


@pytest.mark.parametrize("bits", [11, 2])
def test_repair_of_odd_rows(spark, monkeypatch, bits):
    """Nulls, ties, repeated rows, clashing columns; small chunks cut every conversation."""
    monkeypatch.setattr(path_ranking, "CHUNK_BITS", bits)
    rows = odd_conversations()
    df = spark.createDataFrame([(*x, "p", "q", "r") for x in rows], "conv_id long, turn long, role string, text string, place string, chunk string, audit string")
    want = plain_conversations(rows)
    got = repaired(df)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)
    assert repaired(df.limit(0)) == {}


def test_chunk_memo_that_starts_anew(monkeypatch):
    """Marks, apostrophes and white space in any order, with a memo that fits a few chunks only."""
    monkeypatch.setattr(byte_chunks, "MEMO_CHUNKS", 50)
    enc, r = byte_chunks.ByteChunks(P.path("byte_bpe_50k.json")), random.Random(1)
    bits = ["a", "b.", "!", "$", "%%", "'", "l'a", "'s", "<", "[x]", "é#", " ", " ", "\n", "für", "the", "x!", "\t", "7", "7.5%", "日本", "…"]
    for _ in range(300):
        texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4))] + [None]
        for t, ids in zip(texts, enc.encode(pa.array(texts, pa.string())), strict=True):
            assert ids.tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids
