import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward_rows, frame, prose, same_rows
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from vouchsafe.llm import counting, packing, tokens, training_order

LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())
ENCODER = tokens.Encoder(tokens.vocabulary_path())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


pieces_of_text = st.sampled_from(
    ["don't", "It's.", "a,", "É", "ß.", "e\u0301", "<|endoftext|>", "<|EndOfText|>", "\x00", " ",
     "\n", "\x1c", "\u00a0", "\u3000", "...", "x.", "X,", "9", "ﬁ", "Σς", "İ", "word", "\x0b", "|"]
)
texts = st.lists(st.one_of(pieces_of_text, st.text(max_size=4)), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_encoder_gives_the_librarys_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist()
    assert got == library_ids(text)


def test_encoder_with_a_full_table(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BYTES", 8000)
    monkeypatch.setattr(tokens, "_SLICE", 25)
    own = tokens.Encoder(tokens.vocabulary_path())
    many = [prose(i, 60) for i in range(6)]
    got = [np.frombuffer(b, "<u4").tolist() for t in many for b in own.encode([t.encode()])]
    assert got == [library_ids(t) for t in many]
    assert own.older and len(own.table) + len(own.older) < 150
    own.forget()
    assert not own.table and not own.older


def test_a_word_is_encoded_once_whatever_its_case_and_marks():
    own, seen = tokens.Encoder(tokens.vocabulary_path()), []

    class Watched:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            seen.append(text)
            return self.library.encode(text, **options)

    own.library, own.words = Watched(own.library), Watched(own.words)
    text = "unheard UNHEARD!! Unheard?! unheard... [unheard Unheard, unheard\n\x0bunheard;"
    assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == library_ids(text)
    assert " ".join(seen).lower().count("unheard") == 2  # the word, and the chunk that starts with a mark
    assert own.encode([text.encode()] * 2) == [np.array(library_ids(text), "<u4").tobytes()] * 2
    assert " ".join(seen).lower().count("unheard") == 2
    assert own.encode([]) == [] and own.encode([b"", b" \n"]) == [b"", b""]


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40), st.integers(1, 12))
def test_spliced_chunks_give_the_whole_texts_ids(text, chunk, overlap):
    text = text.encode("utf-8", "ignore").decode()
    got = [i for run in counting.spliced_ids(ENCODER, text.encode(), chunk, overlap) for i in run]
    assert got == library_ids(text)


def test_overlaps_widen_until_white_space(monkeypatch):
    text = ("ab" * 700 + " ") * 4 + prose(8, 400)
    got = [i for run in counting.spliced_ids(ENCODER, text.encode(), 300, 8) for i in run]
    assert got == library_ids(text)


def test_long_texts_without_spaces_take_time_in_proportion():
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh0123,語文字") for _ in range(400_000))
    took = []
    for part in (text[:100_000], text):
        started = time.time()
        n = counting.token_count(ENCODER, part.encode())
        took.append(time.time() - started)
    assert n == len(library_ids(text)) and took[1] < 12 * took[0] + 1


def test_counts_of_awkward_documents(spark):
    rows = awkward_rows()
    got = counting.counted(frame(spark, rows), chunk=1 << 10, overlap=64)
    same_rows(got.select("doc_id", "n_tokens"), [(i, len(library_ids(t))) for i, t in rows])
    assert counting.counted(frame(spark, [])).count() == 0
    assert set(frame(spark, []).columns) < set(got.columns)


def cut(rows, capacity):
    for i, t in rows:
        ids = [*library_ids(t), packing.END_ID]
        for number, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            yield i, number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_pieces_are_packed_without_gaps(spark):
    rows = awkward_rows()
    got = packing.pack_documents(frame(spark, rows)).cache()
    same_rows(
        got.select("doc_id", "piece", "start", "length", "ids_crc32"), list(cut(rows, 4096))
    )
    filled = {}
    for r in got.collect():
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(frame(spark, [])).count() == 0


def first_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, free in enumerate(bins):
            if x <= free:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_the_plan_places_every_piece_once(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.make_plan(counts, 64)
    used = {}
    for x, n in counts.items():
        sequence, offset = plan.place(np.full(n, x), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            used.setdefault(s, []).append((o, x))
    assert len(used) == plan.sequences
    for parts in used.values():
        end = 0
        for o, x in sorted(parts):
            assert o == end
            end += x
        assert end <= 64
    assert plan.sequences >= -(-sum(lengths) // 64)
    # exact combinations first may cost a sequence or two against first fit decreasing
    assert plan.sequences <= first_fit_decreasing(lengths, 64) * 1.15 + 1


def test_many_pieces_reach_the_lower_bound():
    r = np.random.default_rng(0)
    lengths = np.minimum(r.lognormal(6.3, 1.0, 20_000).astype(int) + 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.make_plan(dict(zip(values.tolist(), counts.tolist())))
    assert plan.sequences <= -(-int(lengths.sum()) // 4096) + 2


def test_sequences_hold_the_ids(spark):
    rows = [(i, prose(i, 50)) for i in range(20)]
    made = packing.pieces(frame(spark, rows), capacity=256)
    from vouchsafe.llm.common import settle

    packed = packing.pack(settle(made), 256)
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = bytes(ids[r.sequence_id])[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    numbers = np.arange(n)
    slots = training_order.feistel(numbers, n, 5)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert training_order.unfeistel(slots, n, 5).tolist() == numbers.tolist()
    if n > 60:
        assert (slots != training_order.feistel(numbers, n, 6)).any()
        assert abs(np.corrcoef(numbers, slots)[0, 1]) < 0.4


@pytest.mark.parametrize("dtype, pad", [("<u2", 0), ("<u4", 99)])
def test_shards_are_a_round_trip(spark, tmp_path, dtype, pad):
    rows = awkward_rows()
    index = training_order.write_shards(
        frame(spark, rows), str(tmp_path), key=3, length=64, per_shard=10, dtype=dtype, pad=pad
    ).cache()
    want = [(i, piece, start, length, crc) for i, piece, start, length, crc in cut(rows, 64)]
    same_rows(index.select("doc_id", "piece", "start", "length", "ids_crc32"), want)
    n = len(want)
    assert sorted(r.slot for r in index.collect()) == list(range(n))
    got = training_order.read_slots(spark, str(tmp_path), 5, 37)
    by_slot = {r.slot: bytes(r.payload) for r in got.collect()}
    assert sorted(by_slot) == list(range(5, min(37, n)))
    for r in index.where("slot >= 5 AND slot < 37").collect():
        ids = np.frombuffer(by_slot[r.slot], dtype)
        assert len(ids) == 64 and (ids[r.length :] == pad).all()
        assert zlib.crc32(ids[: r.length].astype("<u4").tobytes()) == r.ids_crc32
        assert r.shard == r.slot // 10 and r.position == r.slot % 10


def test_files_of_shards_follow_each_other(spark, tmp_path):
    docs = frame(spark, [(i, prose(i, 200)) for i in range(60)])
    total = training_order.write_shards(docs, str(tmp_path), key=1, length=16, per_shard=7, shards_per_file=5).count()
    files = spark.read.parquet(f"{tmp_path}/shards").select("slot", F.input_file_name().alias("f"), F.spark_partition_id())
    ranges = sorted((min(s), max(s), s) for s in ([r.slot for r in g] for g in groups(files.collect(), "f")))
    assert len(ranges) == -(-total // 35)
    for (low, high, slots), start in zip(ranges, range(0, total, 35)):
        assert (low, high) == (start, min(start + 35, total) - 1) and slots == sorted(slots)


def groups(rows, name):
    out = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out.values()


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="do not fit"):
        training_order.write_shards(frame(spark, [(1, prose(1, 30))]), str(tmp_path), dtype="<u1")


def test_no_documents_make_no_shards(spark, tmp_path):
    assert training_order.write_shards(frame(spark, []), str(tmp_path)).count() == 0
