"""SentencePiece coding against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import pieces
from tilewright.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(MODEL)


def coded(coder, texts):
    raw = [t.encode() for t in texts]
    ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    back, back_at = coder.decode(ids, at)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], [back[a:b].tobytes().decode() for a, b in zip(back_at[:-1], back_at[1:], strict=True)]


def agree(coder, library, texts):
    ids = [library.encode(t) for t in texts]
    assert coded(coder, texts) == (ids, [library.decode(i) for i in ids])


def test_op12(spark, sf_dir, duck, library):
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, sf_dir).collect()}
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), *digests)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab cde▁\t\n\x00<>0x"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text(coder, library, texts):
    agree(coder, library, texts)


def test_pieces_put_together(coder, library):
    """Pieces in any order, also those that are part of one ranked before them."""
    rng = np.random.default_rng(5)
    pool = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    agree(coder, library, ["".join(pool[k] for k in rng.integers(0, len(pool), 20)) for _ in range(1500)])
    agree(coder, library, ["".join(pool[k].strip() for k in rng.integers(0, len(pool), 8)) for _ in range(1500)])


def test_long_words_and_runs(coder, library):
    rng = np.random.default_rng(6)
    agree(coder, library, ["a" * 5000, "ab" * 5000, " " * 3000, "\n" * 999, "".join(map(chr, rng.integers(97, 123, 20_000))), "字" * 2000])


def test_words_whose_hashes_clash(library):
    few = pieces.Coder(MODEL, hash_mask=3)
    agree(few, library, ["the quick brown fox", "the the fox quick jumped", "a b c d e"] * 3)


def test_known_words_are_forgotten(coder, library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    for k in range(5):
        agree(coder, library, [f"words of round {k} and more words", "again words"])


def test_bytes_that_are_no_text(coder, library):
    rng = np.random.default_rng(7)
    byte = [i for i in range(library.get_piece_size()) if library.is_byte(i)]
    for _ in range(200):
        ids = [int(rng.choice(byte)) if rng.random() < 0.8 else int(rng.integers(0, 3000)) for _ in range(rng.integers(1, 12))]
        back, _ = coder.decode(np.array(ids), np.array([0, len(ids)]))
        assert back.tobytes().decode() == library.decode(ids), ids


def test_odd_rows(spark, make, odd, library):
    docs = make(*odd).withColumn("ids", __import__("pyspark").sql.functions.lit(1)).withColumnRenamed("lang", "decoded")
    rows = pieces.encode(docs, MODEL)
    want = sorted((str(i), np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes(), (t or "")) for i, t in odd)
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in rows.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(rows, MODEL).collect()) == [(i, t) for i, _, t in want]
    assert pieces.encode(make(), MODEL).collect() == []
