"""Packing: ids equal the library's on whole texts, sequences keep every limit, and few sequences are used."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import packing, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return packing.tokenizer(public_tokenizers.path(packing.MODEL))


def ids_of(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 1]


def check_sequences(rows, tokens, most_pieces=None, most_work=None):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(n for _, n in own) <= tokens
        assert len(own) <= (most_pieces or tokens) and sum(n * n for _, n in own) <= (most_work or tokens**2)
    return len(held)


def test_query_over_the_table(spark, model):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    frame = registry.QUERIES["op13_best_fit_packing"](spark, DATA)
    assert frame.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    got, want = frame.collect(), []
    for i, text in texts:
        ids = ids_of(model, text)
        want += [(i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    n = check_sequences(got, 4096)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // 4096) + 1


def test_units_give_the_ids_of_whole_texts(model, monkeypatch):
    """Odd texts: stops, quotes, special strings, combining marks, other white space and scripts."""
    rng = random.Random(1)
    parts = ["Word", "word", "É", "é", "é", "́", "ß", "İ", "Σς", ".", ",", "!?", ":;", "'s", "'T", "…", "—", "1", "²", "½", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "　", "​", "\u0085", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<", ">", "≠", ";̸", "가", "ᄀ", "ᅡ", "漢字", "😀", "K", "ﬁ", "x", "A.b", "a_b", "-", '"', "(", "\x00"]
    table = packing.UnitTable(public_tokenizers.path(packing.MODEL))
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(6000)]
    data = [t.encode() for t in texts]
    ids, offsets = table.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want[i], repr(text)
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    for i in range(0, 200, 20):
        joined = " ".join(texts[i : i + 20])
        assert table.encode_parts(np.frombuffer(joined.encode(), np.uint8)).tolist() == model.encode(joined, add_special_tokens=False).ids


def test_plain_words_are_merged_as_by_the_tokenizer(model):
    rng = random.Random(2)
    letters = "aaabcdeeefghiiijklmnooopqrstuvwxyzßàéèêëçñöüÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 22))) for _ in range(4000)] + ["a" * n for n in range(1, 60)] + ["the", "être", "÷", "é÷a", "ab" * 30]
    table = packing.UnitTable(public_tokenizers.path(packing.MODEL))
    data = " ".join(words).encode()
    ids, _ = table.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert ids.tolist() == model.encode(" ".join(words), add_special_tokens=False).ids
    assert len(table.known) < 100  # only the long and odd ones went to the tokenizer


def test_table_is_emptied_and_filled_again(model, monkeypatch):
    monkeypatch.setattr(packing, "TABLE_UNITS", 3)
    table = packing.UnitTable(public_tokenizers.path(packing.MODEL))
    for text in ("one two three four five", "six seven one", "two"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert table.encode(data, np.array([0, len(data)]))[0].tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("most_pieces", "most_work"), [(None, None), (3, None), (None, 100 * 100), (2, 12_000)])
def test_every_capacity_binds(spark, most_pieces, most_work):
    rng = random.Random(3)
    lengths = [rng.choice([100, 99, 60, 50, 41, 40, 33, 20, 7, 1, 1, 1]) for _ in range(3000)] + [1] * 2000
    frame = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").repartition(5)
    rows = packing.packed(frame, 100, most_pieces, most_work).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    n = check_sequences(rows, 100, most_pieces, most_work)
    least = max(-(-sum(lengths) // 100), -(-len(lengths) // (most_pieces or 100)), -(-sum(x * x for x in lengths) // (most_work or 10_000)))
    assert n <= 1.25 * least + 1


def test_plan_against_one_piece_at_a_time():
    """The plan of equal pieces together uses as many sequences as best fit decreasing, piece by piece."""
    rng = random.Random(5)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
        counts = {n: lengths.count(n) for n in set(lengths)}
        room = []
        for n in lengths:
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(100 - n)
        plan = packing.best_fit(counts, (100, 100, 10_000), (1.0, 0.0, 0.0), "norm")
        assert plan.n == len(room)
        assert packing.fewest(counts, (100, 100, 10_000)).n <= plan.n


def test_plan_does_not_grow_with_the_pieces():
    steps = [len(packing.best_fit({n: 10**k + n for n in range(1, 200)}, (400, 400, 160_000), (1.0, 0.0, 0.0), "norm").low) for k in (2, 9)]
    assert steps[1] < 3 * steps[0]


def test_real_sequences_and_odd_inputs(spark, model):
    long = "lorem ipsum. " * 3000
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, long), (5, " \n ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "PIECE": F.lit(1), "order": F.lit(2), "part": F.lit(None).cast("int")})
    found = packing.pack_documents(frame, 64).cache()
    check_sequences(found.collect(), 64)
    whole = defaultdict(list)
    for r in found.where("doc_id is not null and doc_id <> 3").orderBy("doc_id", "piece").collect():
        assert r["start"] == len(whole[r["doc_id"]]) == 64 * r["piece"] and r["length"] == len(r["ids"])
        whole[r["doc_id"]] += r["ids"]
    assert whole == {i: ids_of(model, text) for i, text in rows if i not in (None, 3)}
    assert found.where("doc_id = 3").count() == 2 and found.where("doc_id is null").count() == 1
    laid = {r["sequence_id"]: r for r in packing.sequences(found).collect()}
    for r in found.collect():
        assert laid[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="room"):
        packing.packed(found, 64, most_work=64)
