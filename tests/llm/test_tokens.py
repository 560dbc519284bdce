import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from linewright.llm import harmonic_pack, token_files
from linewright.llm.tokens import BatchEncoder
from linewright.session import fresh_dir

from .conftest import SCHEMA, prose

TEXTS = [
    "", " ", "Hello, World. it's  don't'S", "a.b,c. d.. e.,", "<|endoftext|> x <|END",
    "\x01 mark \x01", "é é ́x 9th 12.5, ½ ǅ ß ΑΣ", "tab\tnl\nvt\x0bfs\x1cx",
    "123. ABC, Ünï. ñ, 中文. العربية, 🙂.", prose(4, 3000), "word." * 300, "'s 't 're",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def test_batches_encode_as_the_library(plain):
    encoder = BatchEncoder()
    for _ in range(2):  # the second time from what is remembered
        for texts in (TEXTS, [t for t in TEXTS if "<|" not in t]):
            offsets, ids = encoder.encode_ended(pa.array([*texts, None]))
            for i, text in enumerate([*texts, None]):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(plain, text)


def expected(plain, rows):
    return {d: np.array(ids_of(plain, t), dtype="<u4") for d, t in rows}


def test_token_files(spark, docs, plain):
    rows = [(7 * i % 31, prose(i, 5 + 40 * (i % 9))) for i in range(31)]
    rows += [(40 + i, t) for i, t in enumerate([*TEXTS, None])]
    frame = docs(rows).selectExpr("*", "1 AS ids", "2 AS part")
    folder = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(frame, folder)
    files = token_files.read_token_files(spark, folder)
    got = {r.doc_id: r for r in token_files.id_checksums(files).collect()}
    start = 0
    for doc, ids in sorted(expected(plain, rows).items()):
        want = (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        assert tuple(got[doc]) == want
        start += len(ids)
    stored = {r.doc_id: r.ids for r in files.collect()}
    assert stored == {d: ids.tolist() for d, ids in expected(plain, rows).items()}


def test_token_files_of_odd_rows(spark, odd_docs):
    folder = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(odd_docs, folder)
    rows = token_files.id_checksums(token_files.read_token_files(spark, folder)).collect()
    assert len(rows) == odd_docs.count()
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_files_without_rows(spark):
    folder = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), folder)
    assert token_files.id_checksums(token_files.read_token_files(spark, folder)).count() == 0


def test_layout_of_the_files(spark, docs):
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    folder = fresh_dir(spark, "test-tokens")
    token_files.write_token_files(docs([(i, prose(i, 200)) for i in range(300)]), folder)
    file = next(f for f in ds.dataset(folder.removeprefix("file://")).files)
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(5)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


@pytest.mark.parametrize("length", [1, 2, 50, 1365, 2049, 3000, 4095, 4096, 4097, 100_003])
def test_cuts(length):
    pieces = harmonic_pack.cut(length)
    assert sum(pieces) == length and max(pieces) <= 4096 and min(pieces) > 0
    assert len(pieces) <= length // 4096 + 6


def check_packing(frame, plain, rows, capacity=4096):
    pieces = frame.collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, ids in expected(plain, rows).items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(p.length for p in pieces))


def test_packing(docs, plain):
    rows = [(i, prose(i, 1 + (i * i * 37) % 2500)) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate([*TEXTS, None])]
    assert check_packing(harmonic_pack.pack(docs(rows)), plain, rows) < 0.05


def test_packing_of_small_and_odd_tables(spark, docs, odd_docs, plain):
    assert harmonic_pack.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    check_packing(harmonic_pack.pack(docs([(1, None)])), plain, [(1, None)])
    rows = harmonic_pack.pack(odd_docs).collect()
    n = sum(r.length for r in rows)
    texts = [r.text for r in odd_docs.collect()]
    assert n == sum(len(ids_of(plain, t)) for t in texts)


def test_packed_ids(docs, plain):
    rows = [(i, prose(i, 10 + (i * 131) % 900)) for i in range(40)]
    pieces = harmonic_pack.cut_documents(docs(rows), capacity=512, with_ids=True)
    placed = harmonic_pack.place(pieces, capacity=512)
    where = {}
    for p in placed.collect():
        where[p.sequence_id, p.offset] = (p.doc_id, p.start, p.length)
    ids = expected(plain, rows)
    for s in harmonic_pack.sequences(placed, capacity=512).collect():
        at = 0
        while at < s.n_tokens:
            doc, start, n = where[s.sequence_id, at]
            assert s.ids[at : at + n] == ids[doc][start : start + n].tolist()
            at += n
        assert at == len(s.ids) <= s.n_padded <= 512
