import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from snapforge.llm import bpe, pieces, simple8b, token_binary  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(reference, texts):
    memo = bpe.encoder(PATH, public_tokenizers.PATTERN)
    ids, lens = memo.ids(texts)
    ends = np.cumsum(lens)
    for t, e, n in zip(texts, ends, lens):
        assert ids[e - n : e].tolist() == reference.encode_ordinary(t)
        assert bpe.load_ranks(PATH).decode(ids[e - n : e].astype(np.int64)) == t.encode()


@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=80))
@settings(max_examples=300, deadline=None)
def test_plain_splitting_is_the_published_pattern(text):
    import regex

    split = pieces.Splitter(public_tokenizers.PATTERN)
    assert split(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_long_pieces(reference):
    memo = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for t in ("a" * 5000, "é" * 400, "ab" * 700):
        assert memo.ids([t])[0].tolist() == reference.encode_ordinary(t)


def test_round_trip_over_odd_rows(odd, reference):
    got = bpe.round_trip(odd.select("doc_id", "text", odd.lang.alias("n_tokens"))).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    text = "naïve ½² 日本語 <|endoftext|> it's"
    assert by[7].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert by[7].ids_sha256 == hashlib.sha256(np.array(reference.encode_ordinary(text), "<u4").tobytes()).hexdigest()


def test_decode_of_a_column(odd):
    got = bpe.decode(bpe.encode(odd)).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got)


def test_empty_table(docs):
    assert bpe.round_trip(docs([])).count() == 0


@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.integers(0, 1), max_size=700), min_size=1, max_size=5))
@settings(max_examples=120, deadline=None)
def test_simple8b_round_trip(lists):
    records = simple8b.encode(np.array([x for xs in lists for x in xs], np.uint64), np.array([len(x) for x in lists]))
    ids, sizes = simple8b.decode(records)
    assert sizes.tolist() == [len(x) for x in lists] and ids.tolist() == [x for xs in lists for x in xs]
    assert simple8b.read_records(simple8b.MAGIC + b"".join(records)) == records


def test_simple8b_refuses_damage():
    with pytest.raises(ValueError):
        simple8b.read_records(b"nope")
    with pytest.raises(ValueError):
        simple8b.read_records(simple8b.MAGIC + simple8b.encode(np.arange(9, dtype=np.uint64), np.array([9]))[0][:-3])


@pytest.mark.parametrize("file_bytes", [1 << 24, 300])
def test_files_hold_all_documents_in_order(spark, odd, file_bytes, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)  # as it is: the string of a special token becomes that token's id
    files, folder = token_binary.store(spark, odd, JSON, 2, folder=f"file://{tmp_path}/ids", file_bytes=file_bytes)
    got = token_binary.read_files(files, folder, with_ids=True).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r in got:
        options = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, x in rows if i == r.doc_id]
        assert bytes(r.ids) in options and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens


def test_no_documents_give_no_files(spark, docs):
    files, folder = token_binary.store(spark, docs([]), JSON, 2)
    assert files.count() == 0 and token_binary.read_files(files, folder).count() == 0
