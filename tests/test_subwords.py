"""Sub-word ids: longest match by its specification, round trip, markers; batches by a sort on one machine."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagframe.operators import subwords as SW
from tagframe.operators import tagging as T

TEXTS = ["Hello <per>Ann O'Neil</per> 42!", "ein Zürichsee, 東京タワー no ١٢", "", None, "   ", "x" * 5000 + " end", "<b> <PER>a</PER>",
         "\U0001F600 emoji café café"]


@pytest.fixture(scope="module")
def vocabulary():
    return SW.Vocabulary()


def longest_match(token, v):
    """Every end tried from the longest down, in the byte alphabet."""
    if token in v.markers:
        return [v.markers[token]]
    w = "".join(SW.byte_alphabet()[b] for b in token.encode())
    out, a = [], 0
    while a < len(w):
        z = next(z for z in range(min(len(w), a + 40), a, -1) if w[a:z] + ("</w>" if z == len(w) else "") in v.ids)
        out.append(v.ids[w[a:z] + ("</w>" if z == len(w) else "")])
        a = z
    return out


def test_every_byte_is_a_piece_of_both_kinds(vocabulary):
    letters = SW.byte_alphabet()
    assert len(set(letters)) == 256 and all(c in vocabulary.ids and c + SW.WORD_END in vocabulary.ids for c in letters)
    assert not set(vocabulary.markers.values()) & set(vocabulary.ids.values()) and vocabulary.pad not in vocabulary.markers.values()


def test_ids_are_the_longest_matches_and_decode_to_the_tokens(spark, vocabulary):
    docs = spark.createDataFrame([(f"k{i}", t, 1) for i, t in enumerate(TEXTS)], "doc_id string, text string, ids int")
    coded = SW.encode(docs, vocabulary=vocabulary)
    tokens = {r.doc_id: r.t or [] for r in docs.select("doc_id", T.tokenize("text").alias("t")).collect()}
    got = {r.doc_id: (r.ids, r.back) for r in coded.select("doc_id", "ids", SW.decode("ids", vocabulary).alias("back")).collect()}
    assert set(got) == set(tokens)
    for key, words in tokens.items():
        assert got[key][0] == [i for w in words for i in longest_match(w, vocabulary)], key
        assert got[key][1] == " ".join(words)
    assert got["k0"][0].count(vocabulary.markers["<per>"]) == 1 and got["k3"][0] == []


def test_sliced_and_chunked_arrays(vocabulary):
    code = vocabulary.coder()
    lists = [["hello", "<org>"], None, [], ["worlds", "hello"]]
    whole = pa.array(lists, pa.list_(pa.string()))
    plain = [[i for w in ws or [] for i in longest_match(w, vocabulary)] for ws in lists]
    assert code(whole).to_pylist() == plain
    assert code(whole.slice(1, 3)).to_pylist() == plain[1:] and code(whole.slice(0, 0)).to_pylist() == []
    assert code(pa.chunked_array([whole.slice(0, 2), whole.slice(2)])).to_pylist() == plain


def test_no_exchange_in_coding(spark):
    plan = SW.encode(spark.range(1).selectExpr("id as doc_id", "'a b' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_batches_follow_the_order_of_length(spark):
    sizes = [3] * 700 + [i % 90 for i in range(1300)]  # one length holds a third of all rows
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").repartition(7) \
        .select("doc_id", F.array_repeat(F.lit(7), F.col("n")).alias("ids"))
    got = SW.padded(rows, pad=-1).collect()
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], hashlib.md5(f"{k}:42".encode()).hexdigest(), k))
    want = {k: (r // SW.BATCH, sizes[order[min(r // SW.BATCH * SW.BATCH + SW.BATCH, len(order)) - 1]]) for r, k in enumerate(order)}
    assert {r.doc_id: (r.batch_no, r.batch_len) for r in got} == want
    for r in got:
        n = sizes[r.doc_id]
        assert r.n_tokens == n and r.input_ids == [7] * n + [-1] * (r.batch_len - n) and r.attention_mask == [1] * n + [0] * (r.batch_len - n)
    assert sum(r.batch_len for r in got) <= 1.1 * sum(sizes)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert SW.padded(SW.encode(none), pad=0).collect() == []


def test_a_batch_is_coded_in_slices_of_bounded_tokens():
    """Rows come once and in order; only a row longer than the bound exceeds it."""
    lists = [["a"] * n for n in (3, 0, 4, 50, 1, 9, 10, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists)], names=["doc_id", "tokens"])
    parts = list(SW.token_slices(batch, 10))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(8))
    assert [x for p in parts for x in p.column(1).to_pylist()] == lists
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 10 for p in parts)
    assert list(SW.token_slices(batch.slice(0, 0))) == []
