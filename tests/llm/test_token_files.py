import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import EDGE
from tokenizers import Tokenizer

from keystrata.llm.text import vocabulary
from keystrata.llm.token_files import ShardReader, WordCache, read_token_files, token_files, write_token_files
from keystrata.sources.shared import fresh_folder

ODD = ["", "  ", "á b", " x\u0085y z \x1c q\x0bw\x0cr", "İSTANBUL ΣΑΣ Σ", "don't I'LL 'S", "e ́x", "日本語　テスト 123.45", "\r\n\t a\r", "<|endoftext|> <|startoftext|>a", "A.. B., c.\nD,x 5. _. É. ².", "a \x01 b", "\x01", " . , ", "x.", "x,\ty", "ÀÉÎ ß ÿ Ÿ µ ª"]


def want(rows):
    tok = Tokenizer.from_file(vocabulary())
    out, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_pieces_give_the_ids_of_whole_texts():
    tok, cache = Tokenizer.from_file(vocabulary()), WordCache(vocabulary())
    for text, ids in zip(ODD, cache.encode_all(ODD), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text
    cache.PIECES = 8
    for text in ["a b c d e f", "g h i j k l a", "a b c"]:
        assert cache.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_every_letter_before_a_stop_gives_the_ids_of_whole_texts():
    tok, cache = Tokenizer.from_file(vocabulary()), WordCache(vocabulary())
    assert cache.by_pieces
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isalnum() or unicodedata.category(chr(c))[0] in "MZPSC") and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    letters = [x for x in letters if not 0x3400 <= ord(x) < 0x9FFF and not 0xAC20 <= ord(x) < 0xD7A0 and not 0x17000 <= ord(x) < 0x18D00 and not 0x20000 <= ord(x) < 0x33000] + ["\u4e00", "\ud7a3", "\U00020000"]
    texts = [f"{x}. a{x}, {x}{x}.\n{x.upper()}.\t<{x}" for x in letters]
    for k in range(0, len(texts), 4096):
        part = texts[k : k + 4096]
        wrong = [t for t, ids, x in zip(part, cache.encode_all(part), tok.encode_batch_fast(part, add_special_tokens=False), strict=True) if ids.tolist() != x.ids]
        assert not wrong, wrong[:5]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    path = public_tokenizers.path(name)
    tok, cache = Tokenizer.from_file(path), WordCache(path)
    assert not cache.by_pieces
    for text, ids in zip(ODD, cache.encode_all(ODD), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_rows_of_one_id_spread_over_shards(spark, make_docs):
    rows = [(7, f"{k:03d} one id, many texts") for k in range(400)] + [(None, f"{k:03d} no id") for k in range(200)]
    folder = fresh_folder(spark, "tokens")
    manifest = write_token_files(spark, make_docs(rows), folder, vocabulary(), 2).collect()
    assert sum(m.n_docs for m in manifest) == 600 and max(m.n_docs for m in manifest) < 400
    got = [tuple(r) for r in read_token_files(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want(rows)


def test_round_trip_of_edges(spark, make_docs):
    rows = [*EDGE, *((100 + k, t) for k, t in enumerate(ODD))]
    got = [tuple(r) for r in token_files(spark, make_docs(rows), vocabulary()).collect()]
    assert sorted(got, key=lambda r: r[1]) == want(rows)


def test_one_document_from_its_frame(spark, make_docs):
    rows = [(k, f"text number {k} of many") for k in range(50)]
    folder = fresh_folder(spark, "tokens")
    manifest = write_token_files(spark, make_docs(rows), folder, vocabulary(), 2).collect()
    tok = Tokenizer.from_file(vocabulary())
    for m in manifest:
        reader = ShardReader(f"{folder}/shard-{m.shard:06d}.zst")
        assert len(reader) == m.n_docs
        for k in (0, len(reader) - 1) if m.n_docs else ():
            assert reader[k].tolist() == [*tok.encode(rows[reader.doc_id(k)][1], add_special_tokens=False).ids, 2]
    assert read_token_files(spark, folder).count() == 50


def test_empty_table(spark, make_docs):
    assert token_files(spark, make_docs([]), vocabulary()).collect() == []
