import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxolyte.llm import packing
from taxolyte.llm.packing import classes, pack, plans
from taxolyte.llm.token_store import Segment, encode_segment, read_documents, read_segments, write_tokens
from taxolyte.llm.tokens import END_ID, PIECES, TextEncoder, default_tokenizer

TEXTS = [None, "", " \n\t", "İstanbul don't we'll <|endoftext|>x a<|startoftext|>", "é̈ ét́ ́x ΣΑΣ',( 12a3 a１２ ½ ñ' ')x abc def", "a b \x1f\x1cq 한글 'İ###", "word### " * 500]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(default_tokenizer(), max_entries=500)


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(encoder, library):
    for group in (50, 10**6):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(TEXTS, group)]
        assert got == [want(library, t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(encoder, library, text):
    assert encoder.encode(text).tolist() == want(library, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**24), max_size=700), min_size=1, max_size=4))
def test_segment_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    doc_ids = [None, *range(1, len(docs))]
    s = Segment(encode_segment(doc_ids, np.array([len(d) for d in docs]), ids))
    assert s.all().tolist() == ids.tolist() and s.doc_ids == doc_ids
    assert s.starts.tolist() == [sum(map(len, docs[:i])) for i in range(len(docs))]
    for i in range(0, len(ids), 37):
        assert s.token(i) == ids[i]


def test_token_store(spark, tmp_path, odd_docs, library):
    path = str(tmp_path / "tokens")
    write_tokens(odd_docs, path, default_tokenizer(), segment_ids=50)
    got = sorted(map(tuple, read_documents(spark, path).collect()), key=lambda r: (r[1], r[2]))
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and [r[0] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    coded = {}
    for r in rows:
        ids = np.array([*want(library, r["text"]), END_ID], "<u4")
        coded.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc_id, start, n, crc in got:
        assert start == at and (n, crc) in coded[doc_id]
        at += n
    assert read_segments(spark, path).count() > 1


def test_empty_store(spark, tmp_path, no_docs):
    path = str(tmp_path / "tokens")
    write_tokens(no_docs, path, default_tokenizer())
    assert read_documents(spark, path).count() == 0


def test_plans():
    per, limit = classes()
    assert (per * limit <= 2048).all() and set(limit[-40:]) == set(range(1, 41))
    for n, pieces in enumerate(plans()):
        assert sum(pieces) == n and len(pieces) <= 3


def check_packing(rows, texts, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    coded = [(d, np.array([*want(library, t), END_ID], "<u4")) for d, t in texts]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in coded)
    for d, ids in coded:
        own = by_doc[d, len(ids)]
        assert all(any(r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for e, x in coded if e == d) for r in own)


def test_packing(spark, odd_docs, library):
    rows = pack(spark, odd_docs, default_tokenizer()).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], library)


def test_packing_is_tight(spark, library):
    docs = [(i, "the cat sat on a mat. " * (i * 7 % 400 + 1)) for i in range(300)]
    rows = pack(spark, spark.createDataFrame(docs, "doc_id long, text string"), default_tokenizer()).collect()
    check_packing(rows, docs, library)
    total, sequences = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert sequences * 2048 <= total * 1.02 + 2048


def test_packing_with_ids(spark, library):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert pack(spark, df, default_tokenizer(), with_ids=True).first()["ids"] == [*want(library, "one two three"), END_ID]


def test_packing_empty(spark, no_docs):
    assert pack(spark, no_docs, default_tokenizer()).count() == 0


def test_full_cache_keeps_the_pieces_of_most_groups(library):
    encoder = TextEncoder(default_tokenizer(), max_entries=50)
    often, again = ([f"{x}{chr(97 + i)}" for i in range(13)] for x in "qz")
    for words in (often, often, again, again, often):
        assert encoder.encode(" ".join(words)).tolist() == want(library, " ".join(words))
    encoder._make_room()  # more than half of the entries recur
    assert set(encoder.index) == {"", *often}
    assert encoder.encode(" ".join([*again, *often])).tolist() == want(library, " ".join([*again, *often]))


def test_packing_remembers_many_pieces(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda spark, docs, *a, **b: asked.update(b) or pack(spark, docs, *a, **b))
    assert packing.op7_packing(spark, "/root/testdata/sf0.001").columns
    assert asked == {"max_entries": PIECES}


def test_pieces_are_looked_up_once(library):
    class Index(dict):
        asked = 0

        def get(self, *x):
            self.asked += 1
            return super().get(*x)

        def __contains__(self, x):
            self.asked += 1
            return super().__contains__(x)

        def __getitem__(self, x):
            self.asked += 1
            return super().__getitem__(x)

    encoder = TextEncoder(default_tokenizer())
    encoder.index = Index(encoder.index)
    text = "aa bb!? cc!? dd... 12 é"
    assert encoder.encode(text).tolist() == want(library, text)
    assert encoder.index.asked == 8  # aa, bb, cc, dd, é; 12; two tails


def test_runs_of_simple_letters_are_merged_in_lower_case(library):
    letters = [chr(i) for i in range(0xC0, 0x100) if chr(i).isalpha()]
    text = " ".join([*(f"{a}x{b}st{a}{b}" for a in letters for b in letters), "Words WORDS words", *map("straße{}".format, letters), "µª ÿŸ éé ſtraße"])
    encoder = TextEncoder(default_tokenizer())
    assert encoder.encode(text).tolist() == want(library, text)
    assert "words" in encoder.index and "Words" not in encoder.index  # both are one piece
