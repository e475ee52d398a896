"""WARC and token records: round trips and damage."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from websieve.llm import token_records as tr
from websieve.llm import warc
from websieve.llm.tables import open_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def expected(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab É,.!'s\n\t\r\u00a0字1-", max_size=40))
def test_encoder_equals_library(text):
    assert tr.encoder(PATH).encode(text) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "\n", "a\n\nb", "a\n", "a b.\nCd e,", "it's we'LL", "<|endoftext|> x", "x " * 500, "a  b", "ﬁ Ω 中 文"])
def test_encoder_cases(text):
    enc = tr.Encoder(PATH, remember=3)
    assert enc.encode_all([text, "other words", text]) == [expected(text), expected("other words"), expected(text)]


def test_special_strings():
    text = "a <|endoftext|> b"
    assert 50256 in np.frombuffer(expected(text), "<u4") and tr.Encoder(PATH).encode(text) == expected(text)
    as_text = Tokenizer.from_file(PATH)
    as_text.encode_special_tokens = True
    assert tr.Encoder(PATH, special_as_text=True).encode(text) == np.array(as_text.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_pre_tokenizer():
    """A file whose pre-tokenizer cuts elsewhere: whole texts go to the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    other, enc = Tokenizer.from_file(path), tr.Encoder(path)
    for text in ("", "Some Words, and  more!", "x\n\ny"):
        assert enc.encode(text) == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tr.Encoder(PATH).cuts and not enc.cuts


def test_records(spark, docs, tmp_path):
    rows = [(9, "b a"), (3, None), (4, ""), (7, "long word " * 3000), (None, "n"), (5, "x\n\ny"), (5, "a")]
    folder = f"file://{tmp_path}/ids"
    manifest = tr.write_records(docs(rows).repartition(3), folder, PATH, shard_bytes=1000)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = expected(t or "") + b"\x02\0\0\0"
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [tuple(r) for r in tr.record_digests(manifest).orderBy("start").collect()]
    assert got == want
    assert [(r.doc_id, len(r.ids)) for r in tr.read_records(manifest).orderBy("start").collect()] == [(w[0], w[2]) for w in want]
    some = manifest.first().file
    in_order = sorted(len(x) for _, x in tr.shuffled_read(some, 1))
    assert len(in_order) == manifest.first().records
    fs, path = open_path(some)
    data = bytearray(open(f"{path}.rec", "rb").read())
    data[20] ^= 1
    open(f"{path}.rec", "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        tr.record_digests(manifest).collect()
    assert tr.token_records(docs([]), PATH).count() == 0


def test_wide_ids():
    ids = np.array([1, 70_000], "<u4")
    back = tr.unpack(tr.pack(-5, ids))
    assert back[0] == -5 and back[1].tolist() == [1, 70_000]


PAGES = [(4, "http://a/4", "same" * 40), (2, "http://a/2", "same" * 40), (3, None, "same" * 40), (1, "http://a/1", "tiny"), (5, "http://a/5\nx", "tiny"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 50), (9, "u", "é" * 50), (10, "u", "WARC/1.1 \r\n\r\n" * 20)]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, headers string")


def want_pages(rows):
    first = {}
    for i, _, h in sorted(rows):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    out = {}
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first.get(h) if first.get(h) not in (None, i) else None
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref else "response", ref)
    return out


def test_warc_round_trip(spark):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages_of(spark, PAGES).repartition(3)).collect()}
    assert got == want_pages(PAGES)
    assert warc.warc_round_trip(pages_of(spark, [])).count() == 0


def records(n, pack):
    one = lambda i: warc.record("response", i, f"http://a/{i}", f"page {i} ".encode() * (3 + i), "00", None, "2024-01-01T00:00:00Z")
    return [gzip.compress(one(i), mtime=0) if pack else one(i) for i in range(n)]


def salvage(data):
    out = list(warc.Salvage(lambda o, k: data[o : o + k], len(data)).run())
    ids = [int(w["warc-record-id"].split(":")[-1].rstrip(">")) for k, _, _, w, _ in out if k == "record"]
    gaps = [(a, b) for k, a, b, _, _ in out if k == "gap"]
    return ids, gaps


@pytest.mark.parametrize("pack", [True, False])
def test_salvage(pack):
    parts = records(6, pack)
    clean = b"".join(parts)
    assert salvage(clean) == (list(range(6)), [])
    edges = np.cumsum([0, *map(len, parts)]).tolist()
    for k in range(6):
        hurt = bytearray(clean)
        at = edges[k] + len(parts[k]) * 3 // 4
        hurt[at] ^= 0xFF
        ids, gaps = salvage(bytes(hurt))
        assert ids == [i for i in range(6) if i != k] and gaps == [(edges[k], edges[k + 1])]
    assert salvage(clean[:-9]) == (list(range(5)), [(edges[5], edges[6] - 9)])
    assert salvage(b"junk" + clean + b"tail") == (list(range(6)), [(0, 4), (edges[6] + 4, edges[6] + 8)])
    assert salvage(clean[: edges[2]] + clean[edges[2] + 5 :])[0] == [0, 1, 3, 4, 5]
    assert salvage(b"") == ([], []) and salvage(b"nothing here") == ([], [(0, 12)])


def test_salvage_across_windows(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 64)
    parts = records(5, True)
    data = parts[0] + b"\x1f\x8b\x08bad" * 30 + b"".join(parts[1:])
    assert salvage(data) == (list(range(5)), [(len(parts[0]), len(parts[0]) + 180)])


def test_gap_log(spark, tmp_path):
    parts = records(4, True)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:-20] + parts[2] + parts[3])
    found = warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "file string"))
    assert sorted(r.page_id for r in warc.page_records(found).collect()) == [0, 2, 3]
    log = warc.gaps(found).first()
    assert (log.offset, log.end) == (len(parts[0]), len(parts[0]) + len(parts[1]) - 20)
