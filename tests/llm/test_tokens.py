"""Operators 1, 3 and 4: exact round trips and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagframe.llm import best_fit, huffman_ids, piece_lattice
from tagframe.llm.bpe import ChunkEncoder, default_path

from .conftest import ODD, SF


@pytest.fixture(scope="module")
def tok():
    return ChunkEncoder(default_path(), memo=300)


def plain(tok, texts):
    return [e.ids for e in tok.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunked_encoding_equals_the_tokenizer(tok):
    random.seed(1)
    letters = list("ab'.,1 \n\té  日!?$") + [" "] * 5 + ["'ll", "<|endoftext|>", "\0", "\1", "\x85", "\xa0"]
    texts = ODD + ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(2000)]
    flat, at = tok.encode([t or "" for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == plain(tok, texts)


def test_code_lengths_are_limited_complete_and_optimal_when_unlimited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    free, short = huffman_ids.code_lengths(counts, 16), huffman_ids.code_lengths(counts, 5)
    assert free[0] == 0 and short.max() == 5
    for lengths in (free, short):
        assert sum(2.0 ** -x for x in lengths if x) == 1
    heap = sorted(int(c) for c in counts if c)
    cost = 0
    while len(heap) > 1:
        a = heap.pop(0) + heap.pop(0)
        cost += a
        heap = sorted(heap + [a])
    assert (counts * free).sum() == cost
    assert huffman_ids.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_block_round_trip_and_ranges():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 1000, 3000)
    lengths = huffman_ids.code_lengths(counts)
    codes, table = huffman_ids.canonical(lengths)
    used = np.flatnonzero(lengths)
    blocks, want = [], []
    for n in (1, 127, 128, 129, 5000):
        ids = rng.choice(used, n)
        payload, marks = huffman_ids.pack_bits(ids, codes, lengths)
        blocks.append((n, marks, payload))
        want.append(ids)
    for got, ids in zip(huffman_ids.unpack_blocks(blocks, table), want):
        assert (got == ids).all()
    n, marks, payload = blocks[-1]
    for a, b in ((0, 5), (127, 300), (4990, 6000), (129, 130)):
        assert (huffman_ids.decode_range(payload, marks, n, a, b, table) == want[-1][a:b]).all()


def check_ids(got, rows, tok):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    want = [np.array(x + [2], "<u4") for x in plain(tok, [t for _, t in rows])]
    start = np.cumsum([0] + [len(w) for w in want])
    keyed = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
    assert keyed == Counter((k, len(w), zlib.crc32(w.tobytes())) for (k, _), w in zip(rows, want))
    assert sorted(r["start"] for r in got) == start[:-1].tolist()


def test_id_files_of_documents_read_back(spark, texts, tok):
    check_ids(huffman_ids.op1_huffman_ids(spark, SF).collect(), list(texts.items()), tok)


def test_id_files_of_odd_rows(spark, odd, none, tok, tmp_path):
    huffman_ids.write_ids(odd, f"{tmp_path}/a", block_ids=100)
    got = huffman_ids.read_ids(spark, f"{tmp_path}/a").selectExpr("doc_id", "start", "n_tokens", "crc32(ids) as ids_crc32").collect()
    check_ids(got, [(r["doc_id"], r["text"]) for r in odd.collect()], tok)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][0] is None
    huffman_ids.write_ids(none, f"{tmp_path}/b")
    assert huffman_ids.read_ids(spark, f"{tmp_path}/b").count() == 0


def test_plan_fills_slots_without_gaps_or_overlaps():
    for seed in range(200):
        random.seed(seed)
        limit = random.choice([7, 20, 64, 2048])
        counts = {random.randint(1, limit): random.randint(1, random.choice([3, 50, 2000])) for _ in range(random.randint(0, 30))}
        used, done = defaultdict(list), Counter()
        for length, lo, hi, first, per, offset in best_fit.plan_slots(counts, limit):
            done[length] += hi - lo
            for r in range(lo, hi):
                used[first + (r - lo) // per].append((offset + (r - lo) % per * length, length))
        assert dict(done) == counts
        for slots in used.values():
            end = 0
            for at, length in sorted(slots):
                assert at == end
                end += length
            assert end <= limit


def test_plan_equals_best_fit_document_by_document():
    for seed in range(60):
        random.seed(seed)
        limit = 50
        lengths = sorted((random.randint(1, limit) for _ in range(random.randint(0, 120))), reverse=True)
        rooms = []
        for n in lengths:
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else limit) - n)
        plan = best_fit.plan_slots(Counter(lengths), limit)
        sequences = {first + (r - lo) // per for _, lo, hi, first, per, _ in plan for r in range(lo, hi)}
        assert len(sequences) == len(rooms)


def check_packing(slots, rows, tok):
    ids = [np.array(x + [0], "<u4") for x in plain(tok, [t for _, t in rows])]
    want = Counter()
    for (key, _), w in zip(rows, ids):
        start = 0
        for i, n in enumerate(best_fit.piece_lengths(len(w), 2048)):
            want[key, i, start, n, zlib.crc32(w[start:start + n].tobytes())] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in slots) == want
    places = defaultdict(list)
    for r in slots:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 2048
    return len(places), sum(len(w) for w in ids)


def test_packing_of_documents(spark, texts, tok):
    n, total = check_packing(best_fit.op3_best_fit_packing(spark, SF).collect(), list(texts.items()), tok)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_packing_of_odd_rows_and_sequences(odd, none, tok):
    packed = best_fit.pack(odd)
    check_packing(packed.slots.collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], tok)
    for r in packed.sequences().collect():
        assert len(r["ids"]) == 4 * r["n_tokens"]
    assert best_fit.pack(none).slots.count() == 0


def test_piece_lattice_is_the_best_path_and_decodes(spark, odd, none, small, texts):
    sp = piece_lattice.load()
    pieces = {p: (i, s) for p, i, s in piece_lattice.piece_rows(sp)}
    known = {}

    def solve(word):
        best = [(0.0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - 16), end):
                sub, way = word[begin:end], None
                if sub in pieces:
                    way = (best[begin][0] + pieces[sub][1], best[begin][1] + [pieces[sub][0]])
                elif len(sub) == 1:
                    raw = sub.encode()
                    way = (best[begin][0] + piece_lattice.BYTE_COST * len(raw), best[begin][1] + [b + 3 for b in raw])
                if way and (best[end] is None or way[0] > best[end][0]):
                    best[end] = way
        return best[-1][1]

    def want(text):
        if not text:
            return []
        words = re.findall("▁?[^▁\n]{1,255}|▁|\n", "▁" + text.replace(" ", "▁"))
        return [i for w in words for i in known.setdefault(w, solve(w) if w not in known else known[w])]

    for frame in (odd, small):
        rows = frame.select("doc_id", "text").collect()
        got = piece_lattice.encode(frame).select("doc_id", "ids", piece_lattice.decode(piece_lattice.F.col("ids")).alias("t")).collect()
        assert Counter((r["doc_id"], tuple(r["ids"]), r["t"]) for r in got) == Counter(
            (r["doc_id"], tuple(want(r["text"])), r["text"] or "") for r in rows)
    assert piece_lattice.encode(none).count() == 0


def test_piece_lattice_stays_in_the_row(spark, odd):
    """No exchange, whatever the documents; slices of a few words give the same ids as one slice."""
    got = piece_lattice.encode(odd, size=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    ids = lambda df: Counter((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert ids(got) == ids(piece_lattice.encode(odd))
