"""The codec against the sentencepiece library."""

import hashlib
import random

import messy
import public_tokenizers
import pytest
import sentencepiece

from creativeaudit.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(2)
    out = ["", " ", "  a b  ", " a", "\n a", "a▁b", "▁▁", " " * 77, "<s> x </s>", "<0x41>", "\x00a", "\U0001F600 é", "\t\ta", "a\xa0b　c", "ﬁ ①",
           "�", "​", "\x85", "\n\n\n", "ᄀᆨ한글", "x" * 3000, "ab" * 2000, "é" * 500, "THE!! QUICK%%% brown###"]
    for _ in range(1500):
        out.append("".join(rng.choice("aeiorstnl  \n▁.,é😀字1290THE") for _ in range(rng.randint(1, 80))))
    return out


def test_same_ids_and_texts_as_the_library(library):
    codec = pieces.Codec(MODEL)
    for text in odd_texts():
        want = library.encode(text)
        assert codec.encode(text) == want and codec.decode(want) == library.decode(want)
        n, ids, back = codec.digests(text)
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert back == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_decoded_texts_come_from_ids(library):
    """One wrong entry of the table of ids changes each decoded text that the id is in, usual words included."""
    codec, text = pieces.Codec(MODEL), "this is the usual text of usual words"
    ids = library.encode(text)
    assert codec.joined(text) == (len(ids), ",".join(map(str, ids)), text.encode())
    broken = pieces.Codec(MODEL)
    broken.surface[ids[1]] = b"#"
    assert broken.joined(text)[:2] == codec.joined(text)[:2]
    assert broken.joined(text)[2] == b"".join([codec.surface[ids[0]][1:], b"#", *[codec.surface[i] for i in ids[2:]]]) != text.encode()


def test_decoding_of_any_ids(library):
    codec, rng = pieces.Codec(MODEL), random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_units_are_remembered_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 8)
    codec = pieces.Codec(MODEL)
    for text in odd_texts()[:200] * 2:
        assert codec.joined(text)[0] == len(library.encode(text)) and len(codec.recent) <= 8


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Codec(str(tmp_path / "m"))


def test_round_trip_of_documents(spark, library):
    rows = messy.documents()
    docs = messy.frame(spark, rows)
    coded = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    got = sorted((messy.key(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in coded)
    assert got == sorted((messy.key(r[0]), library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in rows)
    assert {r["block"] for r in coded} == {"extra block"}
    digests = pieces.encoded_digests(docs, MODEL).collect()
    assert sorted((messy.key(r["doc_id"]), r["n_tokens"]) for r in digests) == sorted((messy.key(r[0]), len(library.encode(r[1] or ""))) for r in rows)
    both = pieces.encode(docs, MODEL, keep_text=False, digest="target").collect()
    decoded = {messy.key(r["doc_id"]) + tuple(r["ids"]): hashlib.sha256(r["decoded"].encode()).hexdigest() for r in coded}
    assert all(r["target"] == decoded[messy.key(r["doc_id"]) + tuple(r["ids"])] for r in both) and len(both) == len(rows)
    assert pieces.encoded_digests(messy.frame(spark, []), MODEL).collect() == []
    assert pieces.encode(messy.frame(spark, []), MODEL).collect() == []
