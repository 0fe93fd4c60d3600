"""SentencePiece encoding, spans and decoding against the library itself."""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm.encoder import tokenizer_path
from voxmill.llm.pieces import MODEL, NORMALIZER, Normalizer, Pieces, digest, encode_pieces, message

TEXTS = [
    None, "", " ", "   ", "a", "  a  b ", "The quick brown fox.\n\nIt's 12345 \t x", "▁", "a▁b ▁ ", "é ü ß 日本語 \U0001f600", "Ａ① ﬁ é ¨x",
    "<s> </s> <unk> <0x41>", "\0 x\0", "a" * 3000, "x " * 2000, "(a)-[b]", "".join(map(chr, range(32, 400))), " " * 100 + "z", "　a b ", "no​break",
]


def with_normalizer(tmp_path, rule: str) -> str:
    """The model with another normaliser: later fields of a message overwrite."""
    spec = message(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())[NORMALIZER][-1]
    size, out = len(spec), bytearray([NORMALIZER << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    path = tmp_path / f"{rule}.model"
    path.write_bytes(open(tokenizer_path(MODEL), "rb").read() + bytes(out) + bytes([size]) + spec + bytes([NORMALIZER << 3 | 2, 4, 4 << 3, 1, 3 << 3, 1]))
    return str(path)


@lru_cache
def both(path: str):
    return Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


def same_as_library(path: str, texts: list) -> None:
    own, library = both(path)
    found = own.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        a, b = found["bounds"][i : i + 2]
        t = t or ""
        want = library.encode(t, return_type="proto")
        assert found["ids"][a:b].tolist() == [p.id for p in want.pieces] == library.encode(t), repr(t)
        spans = [(p.begin, p.end) for p in want.pieces]
        assert list(zip(found["lo"][a:b].tolist(), found["hi"][a:b].tolist())) == spans, repr(t)
        assert own.decode(found["ids"][a:b]) == library.decode(library.encode(t))


def test_model(tmp_path):
    same_as_library(tokenizer_path(MODEL), TEXTS)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_maps(tmp_path, rule):
    same_as_library(with_normalizer(tmp_path, rule), TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,'1\n▁é́ﬁ日Ａ¨　\0"), max_size=12), min_size=1, max_size=4))
def test_any_text(tmp_path_factory, texts):
    path = tmp_path_factory.getbasetemp() / "nmt_nfkc.model"
    if not path.exists():
        with_normalizer(path.parent, "nmt_nfkc")
    same_as_library(str(path), texts)
    same_as_library(tokenizer_path(MODEL), texts)


def test_normalizer_alone():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = message(message(library.serialized_model_proto())[NORMALIZER][-1])
    text = "  Ａ①  ﬁ¨ ½　 "
    norm, limits, _, _ = Normalizer(spec[2][-1], False, True).normalize(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert norm.tobytes().decode().replace(" ", "▁") == library.normalize(text).replace(" ", "▁").removeprefix("▁")


def test_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(open(tokenizer_path(MODEL), "rb").read() + bytes([2 << 3 | 2, 2, 3 << 3, 1]))
    with pytest.raises(ValueError, match="BPE"):
        Pieces(str(path))


def test_query(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (3, "   ", "z"), (3, "   ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, digest(encode_pieces(docs)).collect()), key=key) == sorted(want, key=key)
    assert digest(encode_pieces(docs.limit(0))).count() == 0


def test_very_long_text(spark):
    text = "Lorem ipsum, dolor 12 " * 60_000 + "x" * 200_000
    row = encode_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["decoded"] == text and row["starts"][0] == 0 and row["ends"][-1] == len(text)
